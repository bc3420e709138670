"""A training corpus from documents: toxic ones go, one of each group of near duplicates stays, benchmark copies go,
secrets are masked, and the sources are mixed to target weights. Each stage is written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.common import sent, table, written
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard import jaccard_join
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.queries import vocabulary
from tidemark.llm.secrets import secret_scan


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, text): the row as one value, so that an operator carries it along without a join."""
    return docs.select(F.struct("*").alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold; the model learns from the labels of documents given here."""
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(whole_rows(docs), model, id_col="row").where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of two rows or more the row of the smallest id stays, or, of rows without one, that of the least text hash.
    Rows without words stay, repeated or not. Of rows of one id and text the one of the least hash stays, so that reruns agree."""
    linked = written(jaccard_join(docs), "components").where("n_links > 0")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"))
    linked = linked.join(sent(first, "first"), "component").withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")))
    named = [F.col("id").alias("of_id"), F.col("h").alias("of_h")]
    gone = sent(linked.where("NOT stays").select(*named).distinct(), "gone", 24)
    again = sent(linked.where("stays").groupBy("id", "h").count().where("count > 1").select(*named), "again", 24)
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("h"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h"))
    stay = rows.join(gone, same, "left_anti")
    return stay.join(again, same, "left_anti").select("row.*").unionByName(stay.join(again, same, "left_semi").groupBy("id", "h").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is covered by benchmark windows."""
    return decontaminate(whole_rows(docs), table(spark, sf_dir, "benchmark"), id_col="row", unnamed=True).where("NOT contaminated").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars counted again."""
    masked = secret_scan(whole_rows(docs), id_col="row", vocabulary=vocabulary()).select("row", "masked_text")
    of = {c: F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in of:
        of["n_chars"] = F.when(of["text"].eqNullSafe(F.col("masked_text")), of["n_chars"]).otherwise(F.length("masked_text").cast(docs.schema["n_chars"].dataType))
    of["text"] = F.col("masked_text")
    return masked.select(*(v.alias(c) for c, v in of.items()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, whole, with size, source_size, target, copies and taken words. Texts of no words are not
    taken. Rows of one id, source and text share their copies evenly; an empty table gives an empty one."""
    return mixed_rows(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
#: The first stage is a learned model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: the documents that all stages keep, texts masked, with the copies that the mix takes of each."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
