"""Views kept up to date by streams: each micro-batch adds the states of its own rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.rollup import AggregatingView


def maintain(source: DataFrame, view: AggregatingView, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs view over each block of the stream and stores its states under path, in a folder for each block.

    The folder's name is the block's number and it is overwritten, so a block that is run again after a failure isn't
    counted twice. every: an interval; without one, all that is there is processed and the query ends.
    """

    def block(rows: DataFrame, number: int) -> None:
        view.states(rows).withColumn("block", F.lit(number)).write.mode("overwrite").parquet(f"{path}/block={number}_")

    writer = source.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def answers(spark: SparkSession, view: AggregatingView, path: str) -> DataFrame:
    """Answers from the blocks stored so far."""
    from tidemark.functions.aggregates import finalised

    return finalised(spark.read.option("recursiveFileLookup", "true").parquet(path), list(view.keys), view.aggregates)


def buffered(source: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, every: str) -> StreamingQuery:
    """Hands what has come in to flush at an interval; how many rows come at a time is the source's option."""
    return source.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def windowed(source: DataFrame, time: str, window: str, late: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by event-time windows, closed once the watermark has passed: state is bounded by lateness."""
    return source.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(*aggregates)
