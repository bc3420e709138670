"""Rollups: views declared once, kept as tables of states, refreshed by blocks, and answered by merging."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.aggregates import Aggregate, direct, finalised, merged_states, state_table

#: Table kinds that merge rows of the same key by adding up or by merging states.
COLLAPSING_KINDS = ("summing", "aggregating", "collapsing", "versioned_collapsing", "graphite")
#: Aggregate functions by their names in lower case.
AGGREGATE_NAMES = ("sum", "avg", "count", "min", "max", "any", "any_last", "anylast", "uniq", "uniqexact", "grouparray", "groupuniqarray", "quantile", "sumif", "countif", "count_if", "any_value", "collect_list", "collect_set", "percentile")


@dataclass(frozen=True)
class AggregatingView:
    """A source's groups and aggregates, kept as states. keys: name to expression over the source."""

    name: str
    keys: dict[str, Column]
    aggregates: list[Aggregate]
    partition_by: Column | None = None
    where: Column | None = None

    def __post_init__(self) -> None:
        if not self.keys or not self.aggregates:
            raise ValueError("a view needs group keys and aggregates")
        names = [*self.keys, *(a.alias for a in self.aggregates)]
        if len(set(names)) < len(names):
            raise ValueError(f"columns of {self.name} are named twice: {names}")

    def states(self, block: DataFrame) -> DataFrame:
        """The states of one block of new rows, and of nothing else."""
        return state_table(block if self.where is None else block.where(self.where), self.keys, self.aggregates)

    def insert(self, block: DataFrame, path: str) -> None:
        """Adds a block's states to the stored table."""
        out, by = self.states(block), []
        if self.partition_by is not None:
            out, by = out.withColumn("part", self.partition_by), ["part"]
        out.write.mode("append").partitionBy(*by).parquet(path)

    def populate(self, source: DataFrame, path: str) -> None:
        """Fills a new table from rows that came before it; refuses one that holds states, which would count them twice."""
        if stored(source.sparkSession, path) is not None:
            raise ValueError(f"{path} holds states already")
        self.insert(source, path)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Answers from all stored states."""
        return finalised(spark.read.parquet(path), list(self.keys), self.aggregates)

    def compact(self, spark: SparkSession, path: str, to: str) -> None:
        """Rewrites stored states with one row for each group."""
        merged_states(spark.read.parquet(path), list(self.keys), self.aggregates).write.mode("overwrite").parquet(to)

    def over_blocks(self, blocks: list[DataFrame]) -> DataFrame:
        """Answers from blocks whose states are never written."""
        states = self.states(blocks[0])
        for b in blocks[1:]:
            states = states.unionByName(self.states(b))
        return finalised(states, list(self.keys), self.aggregates)

    def direct(self, source: DataFrame) -> DataFrame:
        return direct(source if self.where is None else source.where(self.where), self.keys, self.aggregates)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path of any file system, or None."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if there.exists(hadoop) and there.listStatus(hadoop) else None


@dataclass
class ViewRegistry:
    """Views by name with the views they are computed after."""

    views: dict[str, tuple[AggregatingView, tuple[str, ...]]] = field(default_factory=dict)

    def register(self, view: AggregatingView, depends_on: tuple[str, ...] = (), target_kind: str = "aggregating") -> list[str]:
        """Adds a view; returns warnings. An aggregate into a table that doesn't merge is an error: its groups would repeat."""
        if target_kind not in COLLAPSING_KINDS:
            raise ValueError(f"{view.name} aggregates, but rows of a {target_kind} table aren't merged")
        self.views[view.name] = (view, depends_on)
        return [f"{view.name} depends on unknown view {d}" for d in depends_on if d not in self.views]

    def order(self) -> list[str]:
        """Names so that each comes after those it depends on; ties by name."""
        left, out = {n: {d for d in deps if d in self.views} for n, (_, deps) in self.views.items()}, []
        while left:
            ready = sorted(n for n, deps in left.items() if not deps - set(out))
            if not ready:
                raise ValueError(f"views depend on each other: {sorted(left)}")
            out.append(ready[0])
            del left[ready[0]]
        return out


def select_is_safe(sql: str, target_kind: str) -> str:
    """ok, error (aggregates into a table that doesn't merge) or warning (plain rows into one that does)."""
    import re

    aggregates = any(m.lower() in AGGREGATE_NAMES for m in re.findall(r"(\w+?)(?:State)?\s*\(", sql))
    if aggregates and target_kind not in COLLAPSING_KINDS:
        return "error"
    return "warning" if not aggregates and target_kind in COLLAPSING_KINDS else "ok"


@dataclass(frozen=True)
class Projection:
    """Aggregates of a table stored beside it, for queries that group by a part of its keys."""

    name: str
    keys: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]

    def build(self, table: DataFrame) -> DataFrame:
        return state_table(table, {k: F.col(k) for k in self.keys}, list(self.aggregates))


def route(table: DataFrame, projections: list[tuple[Projection, DataFrame]], keys: list[str], aggregates: list[Aggregate], where: Column | None = None, where_columns: tuple[str, ...] = ()) -> tuple[DataFrame, str | None]:
    """(answer, name of the projection it came from): the one with fewest keys that has all groups, filters and aggregates."""
    wanted = {(a.name, a.alias) for a in aggregates}
    for projection, states in sorted(projections, key=lambda p: len(p[0].keys)):
        if set(keys) | set(where_columns) <= set(projection.keys) and wanted <= {(a.name, a.alias) for a in projection.aggregates}:
            return finalised(states if where is None else states.where(where), keys, aggregates), projection.name
    return direct(table if where is None else table.where(where), {k: F.col(k) for k in keys}, aggregates), None
