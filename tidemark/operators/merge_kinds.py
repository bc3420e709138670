"""Tables whose rows of the same sorting key merge: what a reader sees after all merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions.aggregates import Aggregate, merged_states


def _last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of greatest order for each key, by an aggregate that is partial before the shuffle: no sort, no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return best.select(*keys, "row.*").select(rows.columns)


def replacing(rows: DataFrame, keys: list[str], sequence: str, version: str | None = None, deleted: str | None = None) -> DataFrame:
    """The newest row of each key: greatest version, then greatest sequence (order of insertion). Rows marked deleted go."""
    order = F.struct(*([version] if version else []), sequence)
    out = _last(rows, keys, order)
    return out.where(F.col(deleted) == 0) if deleted else out


def summing(rows: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Sums of the declared columns, by default all numeric ones; others take some value of the key's rows."""
    rest = [f for f in rows.schema.fields if f.name not in keys]
    columns = [f.name for f in rest if isinstance(f.dataType, NumericType)] if columns is None else columns
    return rows.groupBy(*keys).agg(*(F.sum(f.name).alias(f.name) if f.name in columns else F.any_value(f.name).alias(f.name) for f in rest)).select(rows.columns)


def aggregating(states: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    return merged_states(states, keys, aggregates)


def collapsing(rows: DataFrame, keys: list[str], sign: str, sequence: str, version: str | None = None) -> DataFrame:
    """Rows of sign 1 and -1 cancel in pairs, by key, and by version if there is one. What is left of more 1 than -1 is
    the last row of sign 1; of more -1 than 1, nothing is shown to a reader."""
    by = [*keys, version] if version else keys
    rest = [c for c in rows.columns if c not in by]
    left = rows.groupBy(*by).agg(F.sum(sign).alias("__left"), F.max_by(F.struct(*rest), F.when(F.col(sign) > 0, F.col(sequence))).alias("row"))
    return left.where("__left > 0").select(*by, "row.*").select(rows.columns)


def collapsed_sums(rows: DataFrame, keys: list[str], sign: str, columns: list[str], version: str | None = None) -> DataFrame:
    """Sums of columns with each row's sign, and how many rows are left, for keys with some left."""
    by = [*keys, version] if version else keys
    return rows.groupBy(*by).agg(*(F.sum(F.col(sign) * F.col(c)).alias(c) for c in columns), F.sum(sign).cast("long").alias("left")).where("left > 0")


def graphite(rows: DataFrame, keys: list[str], time: str, value: str, now: Column, rules: list[tuple[int, int]], how: str = "avg") -> DataFrame:
    """Points of a series, rounded down to a precision that depends on age. rules: (age in seconds, precision in
    seconds); that of the greatest age reached holds. how: avg, sum, min, max or last."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(time).cast("timestamp"))
    second = F.unix_timestamp(F.col(time).cast("timestamp"))
    precision = F.lit(1)
    for at, step in sorted(rules):
        precision = F.when(age >= at, F.lit(step)).otherwise(precision)
    bucket = (second - F.pmod(second, precision)).cast("long")
    value_of = {"avg": F.avg(value), "sum": F.sum(value), "min": F.min(value), "max": F.max(value), "last": F.max_by(value, time)}[how]
    return rows.withColumn("bucket", F.timestamp_seconds(bucket).cast("timestamp_ntz")).groupBy(*keys, "bucket").agg(value_of.alias(value), F.count("*").alias("points"))


def deduplicated(rows: DataFrame, columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """One row for each combination of columns, by default of all; with order, the one of least order."""
    if columns is None or order is None:
        return rows.dropDuplicates(columns) if columns else rows.dropDuplicates()
    rest = [c for c in rows.columns if c not in columns]
    return rows.groupBy(*columns).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*columns, "row.*").select(rows.columns)


def optimised(kind: str, rows: DataFrame, **options) -> DataFrame:
    """The merged table of a kind, to be written in place of rows; merging it again changes nothing."""
    kinds = {"replacing": replacing, "summing": summing, "aggregating": aggregating, "collapsing": collapsing, "versioned_collapsing": collapsing, "graphite": graphite}
    return kinds[kind](rows, **options) if kind in kinds else rows
