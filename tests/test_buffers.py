import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources.engines import TableKind
from tidemark.streaming.buffers import Thresholds, _Layer, buffered


def test_thresholds_of_a_declaration():
    kind = TableKind.parse("Buffer(db, t, 16, 10, 100, 10000, 1000000, 10000000, 100000000)")
    assert Thresholds.parse(kind.args) == Thresholds()
    with pytest.raises(ValueError, match="nine"):
        Thresholds.parse(("db", "t", "1"))


@pytest.mark.parametrize(("rows", "size", "age", "want"), [(1, 1, 100, "max_time"), (10**6, 1, 0, "max_rows"), (1, 10**8, 0, "max_bytes"), (10**4, 10**7, 10, "min"), (10**4, 10**7, 9, None), (10**4 - 1, 10**7, 50, None)])
def test_all_of_the_least_or_any_of_the_most(rows, size, age, want):
    assert Thresholds().reason(rows, size, age) == want


def test_flushes_by_rows_and_time_and_over_a_restart(spark, tmp_path):
    at, seen = f"file://{tmp_path}", []
    limits = Thresholds(layers=2, min_time=1000, max_time=6, min_rows=10**9, max_rows=40, min_bytes=10**9, max_bytes=10**9)

    def flush(rows, number):
        seen.extend(rows.collect())

    def run(until):
        source = spark.readStream.schema("id long, name string").parquet(f"{at}/in")
        flow = buffered(source, flush, f"{at}/offsets", limits, "500 milliseconds")
        end = time.monotonic() + 120
        while not until() and time.monotonic() < end and flow.isActive:
            time.sleep(0.5)
        flow.stop()
        assert flow.exception() is None

    row = F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), F.col("id"))).alias("name")
    spark.range(100).select("id", row).write.mode("append").parquet(f"{at}/in")
    run(lambda: seen)
    assert {r["__rows"] for r in seen if r["__reason"] == "max_rows"} == {40}
    spark.range(100, 105).select("id", row).write.mode("append").parquet(f"{at}/in")
    run(lambda: len(seen) >= 105)
    assert sorted((r.id, r.name) for r in seen) == [(i, f"é{i}" if i % 3 else None) for i in range(105)]
    late = [r for r in seen if r["__reason"] == "max_time"]
    assert late and all(r["__age_ms"] >= 6000 for r in late)
    flushes = {}
    for r in seen:
        flushes.setdefault((r["__layer"], r["__flush"]), []).append(r["__rows"])
    assert all(len(v) == v[0] for v in flushes.values())


class _Counted:
    """Stands in for a handle, its states and its timers, and counts what is asked of them."""

    def __init__(self):
        self.asked, self.held, self.timers, self.value = 0, [], [], None

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return type("Sums", (), {"exists": lambda _: self.value is not None, "get": lambda _: self.value, "update": lambda _, v: setattr(self, "value", v)})()

    def registerTimer(self, at):
        self.timers.append(at)

    def appendList(self, rows):
        self.asked, self.held = self.asked + 1, self.held + list(rows)

    def get(self):
        self.asked += 1
        return iter(self.held)

    def clear(self):
        self.asked, self.held = self.asked + 1, []

    def getCurrentProcessingTimeInMs(self):
        return 5000


def test_rows_of_a_large_block_pass_by_the_state_and_are_handed_on_as_they_come():
    handle, layer = _Counted(), _Layer(Thresholds(layers=1, min_time=100, max_time=200, min_rows=10**9, max_rows=100, min_bytes=10**9, max_bytes=10**9))
    layer.init(handle)
    texts, read = [f"é{i}" for i in range(10_030)], []

    def block(some):
        for i in range(0, len(some), 50):
            read.append(i)
            yield pd.DataFrame({"value": some[i : i + 50]})

    flow = layer.handleInputRows((0,), block(texts), handle)
    first = next(flow)
    assert len(first) == 100 and len(read) == 2  # not the whole block
    flushes = [first, *flow]
    assert [len(f) for f in flushes] == [100] * 100 and [f["flush"][0] for f in flushes] == list(range(100))
    assert handle.asked == 1 and len(handle.held) == 30 and sorted(handle.timers) == [105_000, 205_000]
    (late,) = layer.handleInputRows((0,), block(["x"] * 75), handle)  # what waited comes first
    assert late["value"].tolist() == texts[10_000:] + ["x"] * 70 and late["rows"].tolist() == [100] * 100
    assert handle.held == [("x",)] * 5 and handle.value[0] == 5
