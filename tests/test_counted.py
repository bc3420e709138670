import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import counted

LEVELS = {"low": 0.0, "a": 0.013, "median": 0.5, "b": 0.77, "high": 1.0}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_quantiles_and_distinct_counts_against_sorted_values(spark, partitions):
    r = random.Random(8)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.randrange(3), r.choice([None, 1.5, -2.0, 1e300, 5e-324, float(r.randrange(40)), r.random()])) for _ in range(600)] + [("one", 0, 4.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, block int, v double").withColumn("n", F.lit(1)).withColumn("value", F.lit("x"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        states = counted.counted(df, {"k": F.col("k"), "block": F.col("block")}, "v")
        got = {x.k: x for x in counted.quantiles(states, ["k"], LEVELS).collect()}
        counts = {x.k: x.uniq_exact for x in counted.distinct_values(states, ["k"]).collect()}
        whole = counted.quantiles(states, [], {"median": 0.5}).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {}
    for k, _, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got.keys() == counts.keys() == groups.keys()
    for k, values in groups.items():
        assert counts[k] == len(set(values))
        for name, p in LEVELS.items():
            assert got[k][name] == pytest.approx(np.percentile(values, p * 100, method="linear"), rel=1e-12)
    assert whole.median == pytest.approx(np.median([v for g in groups.values() for v in g]))


def test_no_group_is_gathered_in_a_cell(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 97).cast("double").alias("v"))
    states = counted.counted(df, {"k": F.col("k")}, "v")
    for out in (counted.distinct_values(states, ["k"]), counted.quantiles(states, ["k"], {"m": 0.5})):
        assert "collect" not in out._jdf.queryExecution().toString()


def test_no_rows_give_no_quantiles(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert counted.quantiles(counted.counted(none, {"k": F.col("k")}, "v"), ["k"], {"m": 0.5}).count() == 0
