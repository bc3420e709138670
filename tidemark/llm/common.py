"""What the operators share: reading tables, cutting lineage, row ids and the held-out split."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.shipping import ship
from tidemark.sources.places import checkpoints

#: White space of the word rules, as a Java character class: words are maximal runs outside of it.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper-case ASCII to lower case and white space to spaces, as a table for bytes.translate.
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder."""
    return f"{checkpoints(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor costs no more than a read of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes up to which a table goes to all executors; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def sent(df: DataFrame, name: str, width: Column | int = 48) -> DataFrame:
    """df, written, and marked for broadcast if its rows, of width bytes each, are few enough."""
    df = written(df, name)
    size = df.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def with_id(df: DataFrame, id_col: str, rest: str, name: str | None = None) -> StructType:
    """The schema of id_col as it is in df, of any type, followed by the columns of a DDL string."""
    return StructType([StructField(name or id_col, df.schema[id_col].dataType), *StructType.fromDDL(rest).fields])


#: Bytes of a batch that a Python worker is given; it holds a few times that.
BATCH_BYTES = 8 << 20


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow on executors that have this package, in batches of at most BATCH_BYTES and a row. Plans are made when they run,
    so the session keeps that setting."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is outside of what models may learn from: crc32 of the id as text, mod 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts, with nulls as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


#: Bytes that are hashed at a time.
PIECE = 1 << 21
_RADIX = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd radix and of its inverse, modulo 2 ** 64."""
    return tuple(np.r_[np.uint64(1), np.cumprod(np.full(PIECE, r, np.uint64))] for r in (_RADIX, pow(_RADIX, -1, 1 << 64)))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in at most PIECE bytes; words are what lies between spaces.

    A word's hash is its bytes as digits in the radix, from prefix sums of the piece, scaled down to its own start.
    """
    power, inverse = _powers()
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])]
    edges = np.diff(np.r_[np.int8(0), (data != 32).view(np.int8), np.int8(0)])
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return starts, mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX)


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in any number of bytes, in pieces that end at a space; a longer word is hashed alone."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            if cut < 0:  # a word of more than a piece
                end = len(data) if (cut := data.find(b" ", end)) < 0 else cut
                word = data[at:end].strip()
                starts.append(np.array([end - len(word)]))
                hashes.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
                at = end
                continue
            end = cut + 1
        s, h = _hash_piece(np.frombuffer(data, np.uint8, end - at, at))
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def hashed_texts(all_texts: list[str], letters: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bounds, hashes) for a few texts at a time: the words of text first + i are hashes[bounds[i]:bounds[i + 1]].

    letters: table for bytes.translate that gives a space for each byte outside of words.
    """
    first = held = 0
    part: list[bytes] = []
    for i, text in enumerate(all_texts):
        data = text.encode().translate(letters)
        part.append(data)
        held += len(data) + 1
        if held >= PIECE // 2 or i == len(all_texts) - 1:
            starts, hashes = hash_words(b" ".join(part))
            offsets = np.cumsum([0, *(len(d) + 1 for d in part)])
            yield first, np.searchsorted(starts, offsets), hashes
            first, held, part = i + 1, 0, []
