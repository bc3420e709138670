import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import skip_index
from tidemark.operators.skip_index import SkipIndex


def stored_at(spark, at):
    for k in range(8):
        rows = [(k * 10 + i, f"file{k} row{i} common words é{k}{i}") for i in range(10)] + [(k * 10 + 100, None), (k * 10 + 200, "ab")]
        spark.createDataFrame(rows, "id int, text string").coalesce(1).write.mode("append").parquet(at)
    return at


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    return stored_at(spark, f"file://{tmp_path_factory.mktemp('skip')}/t")


@pytest.fixture
def stored(spark, tmp_path):
    return stored_at(spark, f"file://{tmp_path}/t")


PATTERNS = ["%file3%", "%row7 common%", "%é51%", "%nothing like it%", "ab", "%b%", "file2 row_ common%", "%", "%100\\%%"]


@pytest.mark.parametrize("index", [SkipIndex(n=4, bits=1 << 14), SkipIndex("token", bits=1 << 14, hashes=2), SkipIndex(n=3, bits=64, hashes=1)])
def test_searches_give_what_a_scan_gives(spark, kept, index):
    filters = skip_index.indexed(spark.read.parquet(kept), "text", index).cache()
    for pattern in PATTERNS:
        want = {r.id for r in spark.read.parquet(kept).where(F.col("text").like(pattern)).collect()}
        assert {r.id for r in skip_index.like(spark, kept, "text", filters, index, pattern).collect()} == want


def test_files_without_the_grams_arent_read(spark, stored):
    index = SkipIndex(n=5, bits=1 << 15)
    filters = skip_index.indexed(spark.read.parquet(stored), "text", index).cache()
    count = lambda p, i=index, f=filters: len(skip_index.files_to_read(spark, stored, f, i, p))
    assert (count("%file3%"), count("%common%"), count("%not there%"), count("%ab%")) == (1, 8, 0, 8)
    false = sum(count(f"%word {k} that is in no file%") for k in range(12))
    assert false <= 0.05 * 12 * 8
    token = SkipIndex("token", bits=1 << 14)
    words = skip_index.indexed(spark.read.parquet(stored), "text", token)
    assert (count("%file3 %", token, words), count("% row3 %", token, words), count("% é64", token, words), count("% words z%", token, words)) == (8, 8, 1, 8)
    # a file that came later is read in any case
    spark.createDataFrame([(1, "not there")], "id int, text string").coalesce(1).write.mode("append").parquet(stored)
    assert count("%not there%") == 1 and [r.id for r in skip_index.like(spark, stored, "text", filters, index, "%not there%").collect()] == [1]


def test_declarations():
    assert SkipIndex.parse("ngrambf_v1(3, 256, 2, 0)") == SkipIndex("ngram", 3, 2048, 2, 0)
    assert SkipIndex.parse("tokenbf_v1(100, 3, 5)") == SkipIndex("token", 0, 832, 3, 5)
    for bad in ("ngrambf_v1(1)", "minmax", "tokenbf_v1(1, 2, 3, 4)"):
        with pytest.raises(ValueError):
            SkipIndex.parse(bad)


def test_one_long_text_takes_one_pass_and_grams_stay_inside_of_texts(spark, tmp_path):
    index, at, long = SkipIndex(n=4, bits=1 << 20), f"file://{tmp_path}/t", "".join(f"é{i} 𝄞" for i in range(100_000))
    spark.createDataFrame([(0, long), (1, "abcX"), (2, None), (3, "Yz"), (4, "defg")], "id int, text string").coalesce(1).write.parquet(at)
    start = time.monotonic()
    got = {r.word: r.bits for r in skip_index.indexed(spark.read.parquet(at), "text", index).collect()}
    assert time.monotonic() - start < 60  # cutting each gram from the text's beginning takes minutes
    want = np.zeros(index.bits, bool)
    index.mark(want, sorted({t[i : i + 4] for t in (long, "abcX", "defg") for i in range(len(t) - 3)}))
    words = np.packbits(want, bitorder="little").view("<i8")
    assert got == {-1: 0} | {int(w): int(words[w]) for w in np.flatnonzero(words)}
