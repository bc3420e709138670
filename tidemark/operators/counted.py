"""Exact distinct counts and quantiles from states that are rows: a row for each value of a group, and how often it came.

States of blocks are united and summed up like any counts, so none holds a group's values in one cell. Quantiles are selected:
the values are dealt out in ranges over all tasks, whatever group they are of; the counts of these cells are a histogram that
tells in which of them a rank lies, and only these are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.places import kept


def counted(rows: DataFrame, keys: dict[str, Column], value: Column | str) -> DataFrame:
    """(keys…, value, n): the state of a block; values that are null aren't counted. Groups without values have no state."""
    value = F.col(value) if isinstance(value, str) else value
    return rows.select(*(e.alias(k) for k, e in keys.items()), value.alias("value")).where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias("n"))


def merged_counts(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of several blocks, or of finer keys, as one of these keys."""
    return states.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def distinct_values(states: DataFrame, keys: list[str], alias: str = "uniq_exact") -> DataFrame:
    """(keys…, alias): the number of different values."""
    return merged_counts(states, keys).groupBy(*keys).agg(F.count("*").alias(alias))


def quantiles(states: DataFrame, keys: list[str], levels: dict[str, float]) -> DataFrame:
    """(keys…, a column for each level by its name): quantiles between the values around their rank, as doubles."""
    merged = merged_counts(states.withColumn("value", F.col("value").cast("double")), keys).select(F.struct(F.lit(0).alias("__all"), *keys).alias("key"), "value", "n")
    cells = kept(merged.repartitionByRange("key", "value").withColumn("cell", F.spark_partition_id()), "cells")
    by_key = Window.partitionBy("key")
    sums = cells.groupBy("key", "cell").agg(F.sum("n").alias("m"))  # for each key, a row for each task that has some of it
    sums = sums.withColumns({"total": F.sum("m").over(by_key), "before": F.sum("m").over(by_key.orderBy("cell")) - F.col("m")})
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    ranks = F.array(*(F.struct(F.lit(name).alias("level"), round_(place(p)).cast("long").alias("rank"), (place(p) - F.floor(place(p))).alias("part"), F.lit(high).alias("high")) for name, p in levels.items() for high, round_ in ((False, F.floor), (True, F.ceil))))
    wanted = sums.select("key", "cell", "before", F.explode(F.filter(ranks, lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("m")))).alias("r"))
    wanted = wanted.select("key", "cell", "r.level", "r.part", "r.high", (F.col("r.rank") - F.col("before")).alias("rank"))
    looked_at = cells.join(wanted.select("key", "cell").distinct(), ["key", "cell"], "left_semi")
    ends = looked_at.withColumn("end", F.sum("n").over(Window.partitionBy("key", "cell").orderBy("value")))
    found = ends.join(wanted, ["key", "cell"]).where("rank < end AND rank >= end - n")
    one = lambda name, high: F.max(F.when((F.col("level") == name) & (F.col("high") == high), F.col("value")))
    between = lambda name: one(name, False) + (one(name, True) - one(name, False)) * F.max(F.when(F.col("level") == name, F.col("part")))
    return found.groupBy("key").agg(*(between(name).alias(name) for name in levels)).select(*(F.col("key")[k].alias(k) for k in keys), *levels)
