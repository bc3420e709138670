"""Statistics of columns and of pairs of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_counts(rows: DataFrame, groups: list[list[str]], exact: bool = True) -> DataFrame:
    """(columns, n): how many combinations of values each group of columns has; rows with a null in it don't count.
    Approximate counts are one pass with a sketch for each group; exact ones expand the rows once for each."""
    one = lambda g: F.when(~F.isnull(F.concat(*(F.col(c).cast("string") for c in g))), F.struct(*g))
    count = (lambda g: F.count_distinct(one(g))) if exact else (lambda g: F.approx_count_distinct(F.xxhash64(one(g))))
    told = F.array(*(F.struct(F.lit(",".join(g)).alias("columns"), count(g).cast("long").alias("n")) for g in groups))
    return rows.agg(told.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def dependency(rows: DataFrame, by: str, on: str) -> DataFrame:
    """(degree): the share of rows whose value of by goes with one value of on only; 1 if by determines on."""
    pairs = rows.groupBy(by, on).agg(F.count("*").alias("n"))
    values = pairs.groupBy(by).agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return values.agg((F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("degree"))
