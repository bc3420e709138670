"""Skip indexes of text columns: for each file of a stored table, Bloom filters of its n-grams or of its tokens.

A filter is rows (file, word, bits): 64 bits of it each, so that it is made by one grouping with a bitwise or, which combines
before the shuffle, and asked by a filter on few rows of each file. N-grams are hashed in Arrow batches, all positions at once: a task hands
on a file's words, not a row for each gram. A search for a text asks for the n-grams, or the whole
tokens, that every match must hold, and reads only the files that may have all of them, and those that aren't indexed yet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship

TOKEN = r"[A-Za-z0-9\u0080-￿]+"
#: Positions that are hashed at a time, files whose bits a task holds, and bytes of a batch of texts.
PIECE, FILES, BATCH_BYTES = 1 << 18, 64, 8 << 20
_RADIX, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class SkipIndex:
    """kind: ngram, of n letters, or token; bits of a file's filter, a multiple of 64; hashes: bits that a gram sets; seed."""

    kind: str = "ngram"
    n: int = 3
    bits: int = 1 << 16
    hashes: int = 3
    seed: int = 0

    @classmethod
    def parse(cls, text: str) -> SkipIndex:
        """From ngrambf_v1(n, bytes, hashes, seed) or tokenbf_v1(bytes, hashes, seed)."""
        m = re.fullmatch(r"\s*(ngrambf_v1|tokenbf_v1)\s*\(([\d\s,]+)\)\s*", text)
        if not m:
            raise ValueError(f"not a skip index of texts: {text}")
        n = [int(x) for x in m[2].split(",")]
        if len(n) != (4 if m[1] == "ngrambf_v1" else 3):
            raise ValueError(f"wrong number of arguments: {text}")
        size, hashes, seed = n[-3:]
        return cls("ngram" if m[1] == "ngrambf_v1" else "token", n[0] if len(n) == 4 else 0, -(-size * 8 // 64) * 64, hashes, seed)

    def tokens(self, text: Column) -> Column:
        """The tokens of a text, as an array."""
        return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)))

    def hashed(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """For each hash the bits of the n-grams that begin at codes, code points of a text, but for the last n - 1."""
        last = len(codes) - self.n + 1
        gram = np.zeros(max(last, 0), np.uint64)
        for j in range(self.n if last > 0 else 0):
            gram = gram * _RADIX + codes[j : last + j]
        for k in range(self.hashes):
            h = (gram ^ np.uint64((self.seed + k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * _MIX
            h = (h ^ (h >> np.uint64(32))) * _MIX
            yield ((h ^ (h >> np.uint64(29))) % np.uint64(self.bits)).astype(np.int64)

    def mark(self, flags: np.ndarray, texts: list[str]) -> None:
        """Sets the bits of the n-grams of texts."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint32)
        inside = np.ones(len(codes), bool)  # n-grams don't reach from one text into the next
        ends = np.cumsum([len(t) for t in texts])
        for j in range(1, self.n):
            inside[(ends - j)[ends >= j]] = False
        for lo in range(0, len(codes), PIECE):
            own = inside[lo : lo + PIECE]
            for bits in self.hashed(codes[lo : lo + PIECE + self.n - 1]):
                flags[bits[own[: len(bits)]]] = True

    def asked(self, pattern: str) -> list[str]:
        """Grams that every text like the pattern holds: those of its literal pieces; of tokens, those with something else on both sides
        in the pattern itself."""
        pieces = re.split(r"(?<!\\)[%_]", pattern)
        pieces = [re.sub(r"\\(.)", r"\1", p) for p in pieces]
        if self.kind == "ngram":
            return sorted({p[i : i + self.n] for p in pieces for i in range(len(p) - self.n + 1)})
        last = len(pieces) - 1
        found = {m[0] for k, p in enumerate(pieces) for m in re.finditer(TOKEN, p) if (m.start() or not k) and (m.end() < len(p) or k == last)}
        return sorted(found)

    def _bits(self, gram: Column) -> Column:
        """Of a token."""
        return F.array(*(F.pmod(F.xxhash64(gram, F.lit(self.seed + k)), F.lit(self.bits)) for k in range(self.hashes)))


def indexed(rows: DataFrame, column: str, index: SkipIndex) -> DataFrame:
    """(file, word, bits) of a stored table's rows, read from files; null texts are in no filter, and each file has a word -1."""
    of = rows.select(F.col("_metadata.file_path").alias("file"), F.col(column).alias("text"))
    if index.kind == "ngram":
        return _ngram_words(of, index).groupBy("file", "word").agg(F.bit_or("one").alias("bits"))
    bit = of.select("file", F.explode(index.tokens(F.col("text"))).alias("gram")).select("file", F.explode(index._bits(F.col("gram"))).alias("bit"))
    set_ = bit.select("file", F.shiftright("bit", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int")).alias("one"))
    files = of.select("file", F.lit(-1).cast("long").alias("word"), F.lit(0).cast("long").alias("one"))
    return set_.unionByName(files).groupBy("file", "word").agg(F.bit_or("one").alias("bits"))


def _ngram_words(texts: DataFrame, index: SkipIndex) -> DataFrame:
    """(file, word, one) of texts (file, text): 64 bits of a file's filter, as one task found them."""

    def words(found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for file, flags in found.items():
            bits = np.packbits(flags, bitorder="little").view("<i8")
            at = np.flatnonzero(bits)
            yield pa.RecordBatch.from_pydict({"file": [file] * (len(at) + 1), "word": np.r_[-1, at], "one": np.r_[0, bits[at]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            of: dict[str, list[str]] = {}
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of.setdefault(file, []).append(text or "")
            for file, some in of.items():
                index.mark(found.setdefault(file, np.zeros(index.bits, bool)), some)
                if len(found) >= FILES:
                    yield from words(found)
                    found = {}
        yield from words(found)

    ship(texts.sparkSession)
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return texts.mapInArrow(run, "file string, word long, one long")


def _needed(spark: SparkSession, index: SkipIndex, grams: list[str]) -> dict[int, int]:
    """By word the bits that a filter must have to hold all grams; no more than these have."""
    if index.kind == "ngram":
        flags = np.zeros(index.bits, bool)
        index.mark(flags, grams)
        bits = np.packbits(flags, bitorder="little").view("<i8")
        return {int(word): int(bits[word]) for word in np.flatnonzero(bits)}
    bits = spark.createDataFrame([(g,) for g in grams], "gram string").select(F.explode(index._bits(F.col("gram"))).alias("bit")).distinct()
    needed = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("mask"))
    return {r.word: r["mask"] for r in needed.collect()}


def candidates(filters: DataFrame, index: SkipIndex, pattern: str) -> DataFrame:
    """(file): those of filters, from indexed(), that may hold a text like the pattern."""
    grams = index.asked(pattern)
    if not grams:
        return filters.select("file").distinct()
    masks = _needed(filters.sparkSession, index, grams)
    mask = F.try_element_at(F.create_map(*(F.lit(x).cast("long") for word, m in masks.items() for x in (word, m))), F.col("word"))
    hits = filters.where(F.col("word").isin(list(masks))).where(F.col("bits").bitwiseAND(mask) == mask)
    return hits.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(masks)).select("file")


def files_to_read(spark: SparkSession, path: str, filters: DataFrame, index: SkipIndex, pattern: str) -> list[str]:
    """The table's files that a search has to read: by name, as they are listed on the driver in any scan."""
    there = spark.read.parquet(path).inputFiles()
    known = {r.file for r in filters.where("word = -1").select("file").collect()}
    hit = {r.file for r in candidates(filters, index, pattern).collect()}
    plain = lambda f: re.sub(r"^file:/+", "/", f)
    known, hit = {plain(f) for f in known}, {plain(f) for f in hit}
    return [f for f in there if plain(f) in hit or plain(f) not in known]


def like(spark: SparkSession, path: str, column: str, filters: DataFrame, index: SkipIndex, pattern: str) -> DataFrame:
    """The table's rows whose column is like the pattern, from the files that may have any."""
    table = spark.read.parquet(path)
    files = files_to_read(spark, path, filters, index, pattern)
    if not files:
        return table.limit(0)
    return spark.read.schema(table.schema).option("basePath", path).parquet(*files).where(F.col(column).like(pattern))
