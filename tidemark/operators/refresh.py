"""Materialized views that are recomputed as a whole, on a schedule and after those they depend on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dml import publish


@dataclass(frozen=True)
class RefreshedView:
    """A catalog table's name, the query that fills it, the views it reads, and seconds between refreshes (None: when asked)."""

    name: str
    select: Callable[[SparkSession], DataFrame]
    depends_on: tuple[str, ...] = ()
    every: int | None = None


def refresh_order(views: list[RefreshedView]) -> list[RefreshedView]:
    """views, each after those it depends on; views that depend on each other are an error."""
    left, out = {v.name: v for v in views}, []
    while left:
        ready = [v for v in left.values() if not any(d in left for d in v.depends_on)]
        if not ready:
            raise ValueError(f"views that depend on each other: {sorted(left)}")
        out += ready
        for v in ready:
            del left[v.name]
    return out


def due(spark: SparkSession, views: list[RefreshedView], refreshed: DataFrame, now: Column) -> list[str]:
    """Names of views that are to be refreshed, in order: never refreshed, or longer ago than every; and all that depend on one of them.
    refreshed: (name, at), a row for each refresh."""
    known = spark.createDataFrame([(v.name, v.every) for v in views], "name string, every int")
    last = refreshed.groupBy("name").agg(F.max("at").alias("at"))
    late = known.join(last, "name", "left").where(F.col("at").isNull() | (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp")) >= F.col("every")))
    names = {r.name for r in late.select("name").collect()}  # a row for each view
    out = []
    for v in refresh_order(views):
        if v.name in names or any(d in out for d in v.depends_on):
            out.append(v.name)
    return out


def refresh(spark: SparkSession, views: list[RefreshedView], folder: str, only: list[str] | None = None) -> list[str]:
    """Recomputes views in order; readers see each one's old rows until its new ones are complete. Returns the names."""
    done = [v for v in refresh_order(views) if only is None or v.name in only]
    for v in done:
        publish(spark, v.name, v.select(spark), f"{folder}/{v.name}")
    return [v.name for v in done]
