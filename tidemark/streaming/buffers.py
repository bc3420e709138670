"""Buffers in front of a table: rows wait in a stream's state, in layers, until enough of them are there or enough time has passed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tidemark.shipping import ship

FLUSHED = "layer int, flush long, reason string, rows long, bytes long, age_ms long, value string"
FIELDS = tuple(f.split()[0] for f in FLUSHED.split(", "))
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Thresholds:
    """Of one layer: it is flushed when all of the least are reached, or any of the most. Times in seconds."""

    layers: int = 16
    min_time: float = 10
    max_time: float = 100
    min_rows: int = 10_000
    max_rows: int = 1_000_000
    min_bytes: int = 10_000_000
    max_bytes: int = 100_000_000

    @classmethod
    def parse(cls, args: tuple[str, ...]) -> Thresholds:
        """From a declaration's arguments: database, table, layers, then least and most time, rows and bytes."""
        n = [float(a) for a in args[2:9]]
        if len(n) != 7:
            raise ValueError(f"a buffer takes nine arguments, not {len(args)}")
        return cls(int(n[0]), n[1], n[2], *(int(x) for x in n[3:]))

    def reason(self, rows: int, size: int, age: float) -> str | None:
        for name, now, most in (("max_time", age, self.max_time), ("max_rows", rows, self.max_rows), ("max_bytes", size, self.max_bytes)):
            if now >= most:
                return name
        return "min" if age >= self.min_time and rows >= self.min_rows and size >= self.min_bytes else None


class _Layer(StatefulProcessor):
    """A layer's state: its rows, and (rows, bytes, time of the first, number of the flush)."""

    def __init__(self, limits: Thresholds):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "value string")
        self.sums = handle.getValueState("sums", "rows long, bytes long, first long, flush long")

    def _flushed(self, key: Any, rows: int, size: int, age: int, flush: int, reason: str, fresh: Sequence[str] = ()) -> Iterator[pd.DataFrame]:
        """The rows of the state, if some of the flush's are there, then fresh ones."""
        values = list(fresh)
        if rows > len(fresh):
            values = [value for (value,) in self.waiting.get()] + values
            self.waiting.clear()
        told = {"layer": key[0], "flush": flush, "reason": reason, "rows": rows, "bytes": size, "age_ms": age}
        yield pd.DataFrame({"value": values}).assign(**told)[list(FIELDS)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Only what still waits at the block's end goes to the state, at once, and gets timers; each flush is handed on as it comes."""
        now = timerValues.getCurrentProcessingTimeInMs()
        n, size, first, flush = self.sums.get() if self.sums.exists() else (0, 0, now, 0)
        fresh: list[str] = []
        for value in (v for some in rows for v in some["value"]):
            if not n:
                first = now
            fresh.append(value)
            n, size = n + 1, size + len(value.encode())
            reason = self.limits.reason(n, size, (now - first) / 1000)
            if reason:
                yield from self._flushed(key, n, size, now - first, flush, reason, fresh)
                n, size, flush, fresh = 0, 0, flush + 1, []
        if fresh:
            self.waiting.appendList([(value,) for value in fresh])
            if n == len(fresh):  # the first of them came now
                for after in {self.limits.min_time, self.limits.max_time}:
                    self.handle.registerTimer(int(first + after * 1000))
        self.sums.update((n, size, first, flush))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, size, first, flush = self.sums.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        reason = n and self.limits.reason(n, size, (now - first) / 1000)
        if reason:  # a timer of rows that are flushed already may find none, or younger ones
            yield from self._flushed(key, n, size, now - first, flush, reason)
            self.sums.update((0, 0, first, flush + 1))

    def close(self) -> None:
        pass


def buffered(source: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, limits: Thresholds, every: str = "1 second") -> StreamingQuery:
    """Hands rows to flush(rows, number of the block) once their layer's thresholds say so, with columns __layer, __flush, __reason, __rows,
    __bytes and __age_ms of the flush they come in. Rows are looked after at each block, so a flush may be late by the
    time that a block takes.

    What waits is in the stream's checkpoint and outlives a restart; a layer holds max_rows rows and max_bytes bytes, with a
    row to spare. Bytes are those of rows as JSON. The session's state store becomes RocksDB, which such states need.
    """
    spark: SparkSession = source.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = StructType(source.schema.fields)
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in source.columns)), {"ignoreNullFields": "false"})
    keyed = source.select(text.alias("value")).withColumn("layer", F.pmod(F.xxhash64("value"), F.lit(limits.layers)).cast("int"))
    out = keyed.groupBy("layer").transformWithStateInPandas(_Layer(limits), FLUSHED, "append", "ProcessingTime")

    def block(rows: DataFrame, number: int) -> None:
        told = [F.col(c).alias(f"__{c}") for c in ("layer", "flush", "reason", "rows", "bytes", "age_ms")]
        flush(rows.select(F.from_json("value", schema).alias("v"), *told).select("v.*", *(f"__{c}" for c in ("layer", "flush", "reason", "rows", "bytes", "age_ms"))), number)

    return out.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
