"""Constraints as queries for the rows that break them, and row policies as filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_null_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.where(reduce(Column.__or__, (F.col(c).isNull() for c in columns)))


def unique_violations(rows: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """(columns, n) of combinations held by several rows; as in SQL, those with a null are all different. where: the predicate of a
    partial index; rows that don't meet it may repeat."""
    return (rows if where is None else rows.where(where)).dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def check_violations(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is false; unknown passes."""
    return rows.where(~predicate)


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str] | None = None) -> DataFrame:
    """Rows whose reference, without nulls, has no parent."""
    keys = parent.select(*(F.col(p).alias(c) for c, p in zip(columns, parent_columns or columns, strict=True))).distinct()
    return child.dropna(subset=columns).join(keys, columns, "left_anti")


def overlaps(rows: DataFrame, keys: list[str], low: str, high: str, id_col: str) -> DataFrame:
    """(id, other): for each range [low, high) that begins before an earlier one of its keys has ended, that one.

    Ranges are sorted by their beginning, and each is held against the one that reaches furthest before it: every range
    in conflict with an earlier one is told, once, without trying the pairs of a key.
    """
    before = Window.partitionBy(*keys).orderBy(low, high, id_col).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct(F.col(high).alias("h"), F.col(id_col).alias("i"))).over(before)
    return rows.where(F.col(low) < F.col(high)).withColumn("__r", reach).where(F.col("__r.h") > F.col(low)).select(F.col(id_col).alias("id"), F.col("__r.i").alias("other"))


def overlap_with_next(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows of a temporal key whose period runs into the next one's start."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, end))
    return rows.withColumn("__next", following).where(F.col("__next") < F.col(end)).drop("__next")


def visible(rows: DataFrame, permissive: list[Column], restrictive: list[Column] = ()) -> DataFrame:
    """Rows that some permissive policy and every restrictive one let pass; none without a permissive policy."""
    some = reduce(Column.__or__, permissive, F.lit(False))
    return rows.where(reduce(Column.__and__, restrictive, some))


def checked(rows: DataFrame, predicate: Column, message: str) -> DataFrame:
    """rows, failing when one is written that doesn't meet the predicate (a view's check option)."""
    return rows.where(F.assert_true(F.coalesce(predicate, F.lit(False)), message).isNull())
