"""Lookups and joins by a declared strictness. Small sides are broadcast only after their size was looked at."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a lookup table may go to all executors.
BROADCAST_BYTES = 64 << 20


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if the optimizer's estimate of its size is at most so many bytes. For files that is their size as they lie,
    compressed; Spark refuses a broadcast table that turns out to be over 8 GB."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def dict_get(rows: DataFrame, table: DataFrame, key: str, attributes: dict[str, object], table_key: str | None = None) -> DataFrame:
    """rows with attributes of a dictionary; attributes: name to default for keys that it lacks. Keys of it are unique:
    of several rows, one with the least attributes counts."""
    table_key = table_key or key
    unique = table.groupBy(F.col(table_key).alias("__key")).agg(F.min(F.struct(*attributes)).alias("__found"))
    joined = rows.join(maybe_broadcast(unique), F.col(key) == F.col("__key"), "left")
    out = {a: F.coalesce(F.col("__found")[a], F.lit(d)) if d is not None else F.col("__found")[a] for a, d in attributes.items()}
    return joined.withColumns(out).drop("__key", "__found")


def range_dict_get(rows: DataFrame, table: DataFrame, key: str, at: str, low: str, high: str, attributes: list[str], grid: int | None = None) -> DataFrame:
    """rows with attributes of the range of their key that holds at, bounds included; null without one. Of overlapping
    ranges the one that starts last counts.

    Ranges and points are joined by equality on key and cell of a grid, so that a hot key is spread over its cells and no pair of
    key equals is tried in full. Grids are told apart by level, each four times as wide as the one below; a range is listed
    in the finest one of which it touches two cells at most, and a point looks into each level that some range is in: as
    many as the logarithm of the widest range. grid: the finest cell's width; without one, by key alone, for tables with few ranges of a key.
    """
    ranges = table.select(F.col(key).alias("__k"), F.col(low).alias("__low"), F.col(high).alias("__high"), *(F.col(a).alias(f"__{a}") for a in attributes))

    def cell(c: Column, level: Column) -> Column:
        return F.floor(c / (grid * F.pow(F.lit(4.0), level))).cast("long")

    points = rows.withColumn("__id", F.monotonically_increasing_id())
    on = F.col(key) == F.col("__k")
    if grid:
        level = F.ceil(F.log(4.0, F.greatest(F.lit(1.0), (F.col("__high") - F.col("__low")) / grid))).cast("int")
        ranges = ranges.where("__low <= __high").withColumn("__level", level)
        ranges = ranges.withColumn("__cell", F.explode(F.sequence(cell(F.col("__low"), F.col("__level")), cell(F.col("__high"), F.col("__level")))))
        levels = [r[0] for r in ranges.select("__level").distinct().collect()]  # a logarithm
        points = points.withColumn("__at_level", F.explode(F.array(*map(F.lit, levels or [0]))))
        on &= (F.col("__at_level") == F.col("__level")) & (cell(F.col(at), F.col("__at_level")) == F.col("__cell"))
    hit = points.join(ranges, on & F.col(at).between(F.col("__low"), F.col("__high")), "left")
    best = F.max_by(F.struct(*(F.col(f"__{a}").alias(a) for a in attributes)), "__low")
    return hit.groupBy("__id", *rows.columns).agg(best.alias("__best")).select(*rows.columns, *(F.col("__best")[a].alias(a) for a in attributes))


def in_set(rows: DataFrame, members: DataFrame, column: str, negate: bool = False) -> DataFrame:
    """Rows whose value is a member; a null is never one."""
    keys = members.select(F.col(members.columns[0]).alias(column)).distinct()
    return rows.join(maybe_broadcast(keys), column, "left_anti" if negate else "left_semi")


def join_table(left: DataFrame, right: DataFrame, keys: list[str], kind: str = "inner", strictness: str = "all", order: str | None = None) -> DataFrame:
    """A join by strictness: all pairs; any, one row of right for each key (of least order); semi; anti."""
    if strictness == "semi":
        return left.join(right.select(keys), keys, "left_semi")
    if strictness == "anti":
        return left.join(right.select(keys), keys, "left_anti")
    if strictness == "any":
        rest = [c for c in right.columns if c not in keys]
        right = right.groupBy(*keys).agg((F.min_by(F.struct(*rest), order) if order else F.min(F.struct(*rest))).alias("__one")).select(*keys, "__one.*")
    elif strictness != "all":
        raise ValueError(f"no such strictness: {strictness}")
    return left.join(right, keys, kind)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with columns of the latest row of right of the same keys at or before it; of equal times, the greatest columns.

    One sort of both sides together by key and time, and one pass with the last right row seen: the work is that of a
    sort, not of the pairs of a key. bucket, of a time, as its day, cuts a key's rows into runs that are sorted apart, so that
    a hot key isn't one task's: each run begins with the last right row of those before it, of which there is one for each run.
    """
    run = (lambda c: bucket(c)) if bucket else (lambda c: F.lit(0))
    keyed = [F.col(k).alias(f"__{k}") for k in keys]
    by = [f"__{k}" for k in keys]
    struct = F.struct(F.col(right_time).alias("__t"), *columns)
    a = left.select(F.struct(*left.columns).alias("__left"), *keyed, F.col(left_time).alias("__at"), run(F.col(left_time)).alias("__run"), F.lit(2).alias("__side"), F.lit(None).alias("__right"))
    b = right.select(F.lit(None).alias("__left"), *keyed, F.col(right_time).alias("__at"), run(F.col(right_time)).alias("__run"), F.lit(1).alias("__side"), struct.alias("__right"))
    both = b.unionByName(a)
    if bucket:
        ends = both.groupBy(*by, "__run").agg(F.max("__right").alias("__right"))
        before = Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("__right", F.last("__right", ignorenulls=True).over(before)).where("__right IS NOT NULL")
        both = both.unionByName(carried.select(F.lit(None).alias("__left"), *by, F.col("__right.__t").alias("__at"), "__run", F.lit(0).alias("__side"), "__right"))
    window = Window.partitionBy(*by, "__run").orderBy("__at", "__side", "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(window)).where("__side = 2")
    return found.select("__left.*", *(F.col("__found")[c].alias(c) for c in columns))


def union_of(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables, by column name; columns that one lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
