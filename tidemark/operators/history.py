"""Migrations and seeds as relations: what was applied, what is pending, what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import version_key


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Files (version, …) whose version isn't in the history."""
    return files.join(applied.where("version IS NOT NULL").select("version"), "version", "left_anti")


def changed(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Files (filename, checksum) that the history lacks or knows with another checksum."""
    known = applied.select("filename", F.col("checksum").alias("__old"))
    return files.join(known, "filename", "left").where("__old IS NULL OR __old <> checksum").drop("__old")


def status_counts(files: DataFrame, applied: DataFrame) -> DataFrame:
    """(status, n) for applied, pending and total."""
    marked = files.join(applied.select("version", F.lit("applied").alias("status")).distinct(), "version", "left").select(F.coalesce("status", F.lit("pending")).alias("status"))
    return marked.unionByName(files.select(F.lit("total").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


def to_revert(applied: DataFrame, target: str) -> DataFrame:
    """Versions after the target, latest first, as (seq, version)."""
    later = applied.where(version_key(F.col("version")) > version_key(F.lit(target)))
    return later.select("version").orderBy(version_key(F.col("version")).desc())


def next_version(files: DataFrame, digits: int = 4) -> DataFrame:
    return files.agg(F.format_string(f"%0{digits}d", F.coalesce(F.max(F.col("version").try_cast("int")), F.lit(0)) + 1).alias("version"))


def latest(rows: DataFrame, by: Column, n: int = 1) -> DataFrame:
    """The n latest rows: a top-n of each partition, then of those."""
    return rows.orderBy(by.desc()).limit(n)


def digest(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One SHA-256 of a relation's content, whatever the order of its rows: of the row digests, sorted. For relations of
    files and schemas; of tables of data, take the sum of row hashes."""
    row = F.sha2(F.concat_ws(";", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in [*order, *columns])), 256)
    return rows.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(row))), 256).alias("digest"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(le, n): cumulative counts of values up to each bound and infinity; one pass, one row of counts."""
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    counts.append(F.struct(F.lit(float("inf")).alias("le"), F.count(value).alias("n")))
    return rows.agg(F.array(*counts).alias("h")).select(F.explode("h").alias("b")).select("b.*")


def migration_name(ops: DataFrame) -> DataFrame:
    """(name): the kinds of operations and their tables, most frequent first, as words."""
    counted = ops.groupBy("op", "table").agg(F.count("*").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "op", "table"))), 1, 3)
    return counted.agg(F.substring(F.array_join(F.transform(top, lambda r: F.concat_ws("_", r.op, r.table)), "__"), 1, 60).alias("name"))
