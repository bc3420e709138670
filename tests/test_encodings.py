import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import encodings


def encodings_of(path):
    out = {}
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.read_metadata(file)
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                out.setdefault(column.path_in_schema, set()).update([*column.encodings, column.compression])
    return out


def test_footers_show_the_encodings_asked_for(spark, tmp_path):
    rows = spark.range(5000).select("id", (F.col("id") * 7 % 5).cast("string").alias("kind"), F.xxhash64("id").alias("noise"), F.col("id").cast("double").alias("x"), (F.col("id") % 3).alias("few"))
    at = str(tmp_path / "t")
    encodings.write_encoded(rows, f"file://{at}", {"id": "CODEC(Delta, ZSTD(3))", "noise": "ZSTD(5)", "few": "DoubleDelta"})
    found = encodings_of(at)
    assert "RLE_DICTIONARY" in found["kind"] and not any("RLE_DICTIONARY" in found[c] for c in ("id", "noise", "x", "few"))
    assert "DELTA_BINARY_PACKED" in found["id"] & found["few"] and all("ZSTD" in e for e in found.values())
    assert sorted(spark.read.parquet(f"file://{at}").collect()) == sorted(rows.collect())


def test_chains_and_their_limits():
    assert encodings.codec_chain("CODEC(Delta, ZSTD(3))") == [("delta", None), ("zstd", 3)]
    assert encodings.writer_options(["a"], {"a": "LZ4"}, ["a"]) == {"parquet.enable.dictionary#a": "true", "compression": "lz4_raw"}
    with pytest.raises(ValueError, match="no such codec"):
        encodings.codec_chain("CODEC(Best)")
    with pytest.raises(ValueError, match="either"):
        encodings.writer_options(["a"], {"a": "Delta"}, ["a"])


def test_no_rows_and_nested_columns(spark, tmp_path):
    rows = spark.range(3).select("id", F.array("id").alias("a"), F.struct("id").alias("s"))
    for k, df in enumerate((rows, rows.where("false"))):
        encodings.write_encoded(df, f"file://{tmp_path}/{k}", {"id": "Delta"})
        assert spark.read.parquet(f"file://{tmp_path}/{k}").count() == df.count()
