"""Changes to tables as DataFrames of the new content, and the swap that puts them in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rollup import stored


def deleted(rows: DataFrame, predicate: Column) -> DataFrame:
    """Without rows that meet the predicate; unknown stays."""
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def updated(rows: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    hit = F.coalesce(predicate, F.lit(False))
    return rows.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def upserted(rows: DataFrame, news: DataFrame, keys: list[str], policy: str = "update") -> DataFrame:
    """rows with news: update replaces rows of the same keys, ignore keeps them, error refuses them. Of several news of
    one key, the one of greatest content counts."""
    rest = [c for c in rows.columns if c not in keys]
    news = news.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__n")).select(*keys, "__n.*").select(rows.columns)
    if policy == "ignore":
        return rows.unionByName(news.join(rows.select(keys), keys, "left_anti"))
    if policy == "update":
        return rows.join(news.select(keys), keys, "left_anti").unionByName(news)
    if policy == "error":
        both = news.join(rows.select(*keys).distinct().withColumn("__old", F.lit(1)), keys, "left")
        clash = F.concat(F.lit("conflict on "), F.to_json(F.struct(*keys)))
        return rows.unionByName(both.where(F.when(F.col("__old").isNotNull(), F.raise_error(clash).cast("boolean")).otherwise(F.lit(True))).select(rows.columns))
    raise ValueError(f"no such policy: {policy}")


def common_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """old in the shape of new: common columns cast, the rest null."""
    return old.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema.fields))


def cleared_column(rows: DataFrame, column: str, in_partition: Column) -> DataFrame:
    return updated(rows, in_partition, {column: F.lit(None)})


def replaced_partition(rows: DataFrame, news: DataFrame, partition: str, value: object) -> DataFrame:
    """rows with the content of one partition taken from news."""
    return rows.where(~F.col(partition).eqNullSafe(F.lit(value))).unionByName(news.where(F.col(partition).eqNullSafe(F.lit(value))))


def swap(spark: SparkSession, content: DataFrame, path: str, keep_old: bool = False) -> str | None:
    """Writes content beside path and renames it into place; the old table is kept under the path returned, or removed. Where
    nothing was, it is a plain write. Between the two renames a reader finds nothing: where readers don't wait, use publish()."""
    jvm = spark._jvm
    to, new, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", "__new", "__old"))
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    content.write.mode("overwrite").parquet(path + "__new")
    had = stored(spark, path) is not None
    if had:
        files.delete(old, True)
        files.rename(to, old)
    files.rename(new, to)
    if had and not keep_old:
        files.delete(old, True)
    return path + "__old" if had and keep_old else None


def publish(spark: SparkSession, table: str, content: DataFrame, folder: str, keep_old: bool = False) -> str | None:
    """Writes content as a new version under folder and points the catalog's table there, by one change of its entry: who resolves
    the table before reads all of the old version, who does after all of the new. Views of the table need no change. The old
    version's path is returned if kept; else it goes, which queries still running on it would notice."""
    at = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    content.write.parquet(at)
    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(table, path=at, source="parquet")
        return None
    before = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{at}'")
    spark.catalog.refreshTable(table)
    if keep_old:
        return before
    old = spark._jvm.org.apache.hadoop.fs.Path(before)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return None
