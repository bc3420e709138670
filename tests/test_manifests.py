import pytest
from pyspark.sql import functions as F

from tidemark.operators.manifests import ManifestTable


def ids(df):
    return sorted(r.id for r in df.collect())


def test_frozen_partitions_outlive_drops_and_replacements(spark, tmp_path):
    t = ManifestTable(spark, f"file://{tmp_path}/t", "k")
    rows = spark.range(30).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))  # a third has no partition key
    t.append(rows.where("id < 20"))
    t.append(rows.where("id >= 20"))
    assert ids(t.read()) == list(range(30))
    t.freeze("all")
    t.freeze("ones", "1")
    t.drop_partition("1")
    t.replace_partition("2", rows.where("k = 2 AND id < 10"))
    assert ids(t.read()) == sorted([*range(0, 30, 3), 2, 5, 8])
    assert ids(t.read("ones")) == list(range(1, 30, 3)) and ids(t.read("all")) == list(range(30))
    assert t.free() == 0  # all files are named by what is frozen
    t.unfreeze("all")
    assert t.free() > 0 and t.free() == 0
    assert ids(t.read("ones")) == list(range(1, 30, 3)) and ids(t.read()) == sorted([*range(0, 30, 3), 2, 5, 8])
    t.unfreeze("ones")
    t.drop_partition("")
    t.drop_partition("2")
    assert t.free() > 0 and t.unnamed().count() == 0
    with pytest.raises(ValueError, match="no rows"):
        t.read()
    with pytest.raises(ValueError, match="frozen as ones"):
        t.unfreeze("ones")


def test_rows_of_other_partitions_cant_replace_one(spark, tmp_path):
    t = ManifestTable(spark, f"file://{tmp_path}/t", "k")
    t.append(spark.range(4).withColumn("k", F.col("id") % 2))
    with pytest.raises(Exception, match="not of partition 1"):
        t.replace_partition("1", spark.range(4).withColumn("k", F.col("id") % 2))
    assert ids(t.read()) == [0, 1, 2, 3]
    t.append(spark.range(0).withColumn("k", F.col("id")))
    assert ids(t.read()) == [0, 1, 2, 3]


def test_names_of_partitions_are_texts(spark, tmp_path):
    t = ManifestTable(spark, f"file://{tmp_path}/t", "k")
    t.append(spark.createDataFrame([(1, "01"), (2, "1"), (3, "a/b=c"), (4, "2024-01-01")], "id long, k string"))
    t.drop_partition("1")
    t.drop_partition("a/b=c")
    assert ids(t.read()) == [1, 4]
