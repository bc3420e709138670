"""Vector code compression by a member-resident Lloyd iteration.

Vectors of integers are cut into parts, and each part's position has a codebook. Parts are rows that live with their owner:
they are partitioned by (position, entry, salt), so that an owner sums up its own members and all owners' sums, a row for each
entry, make the next codebook. Members are then held against it where they lie. Those that keep their entry are read again
from where they were written; only those that change it go through the next shuffle, to their new owners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mapped, sent, written
from tidemark.llm.knn import matrix, quantized

#: Members of an entry that one owner has, about; entries of more have several owners, told apart by the salt.
OWNED = 8192
MEMBERS = "position int, entry int, row long, part array<long>"


def held_against(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, by squared distance, ties to the lower index; and that distance."""
    entry, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    step = max(1, (1 << 20) // max(1, book.size))
    for b in range(0, len(parts), step):
        far = ((parts[b : b + step, None, :] - book[None]) ** 2).sum(axis=2)
        entry[b : b + step] = far.argmin(axis=1)
        error[b : b + step] = far.min(axis=1)
    return entry, error


def next_books(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of the members' means, rounded down; entries without members stay. Owners' sums come in, not members."""
    width = books.shape[2]
    sums = members.groupBy("position", "entry").agg(F.count("*").alias("n"), *(F.sum(F.col("part")[i]).alias(f"s{i}") for i in range(width)))
    out = books.copy()
    for r in sums.collect():  # a row for each entry of each position
        out[r.position, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def vector_codes(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector, by codebooks fitted to all vectors.

    Components are floor(scale * x). The first entries are the parts of the vectors of smallest id, those without one last,
    equal ids by vector; with fewer vectors there are fewer entries. Each round assigns all parts and replaces entries by
    their parts' means, rounded down; ties go to lower indexes. code: two hex digits a part; error: squared distances, summed
    up; label_error: that of all rows of an equal label, nulls together. Vectors that are null or hold null or non-finite
    components have no row; rows without an id and repeated rows have one each. Shorter vectors, and vectors whose length the parts
    don't divide, count as ended by zeros. scale * x is at most 2 ** 26 in size, as sums of squares are of 64 bits. An empty table
    gives no rows. Other columns are ignored.
    """
    named = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), quantized(vectors[vector_col], scale).alias("v")).where("v IS NOT NULL")
    rows = written(named.withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width, salts = max(1, -(-d // parts)), max(1, -(-total // OWNED))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    books = matrix(first["v"], width * parts).reshape(-1, parts, width).transpose(1, 0, 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = matrix(batch.column(1), width * parts).reshape(-1, parts, width)
            for p in range(parts):
                entry, _ = held_against(whole[:, p], books[p])
                part = pa.FixedSizeListArray.from_arrays(pa.array(whole[:, p].ravel()), width).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), batch.column(0), part], ["position", "entry", "row", "part"])

    def at_owners(moving: DataFrame, name: str) -> DataFrame:
        return written(moving.repartition("position", "entry", F.pmod(F.xxhash64("row"), F.lit(salts))), name)

    def kept_or_moved(members: DataFrame, books: np.ndarray, name: str) -> DataFrame:
        """members with the entry that they have now, and error."""

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                position, sub = batch.column(0).to_numpy(), matrix(batch.column(3), width)
                entry, error = np.zeros(len(sub), np.int64), np.zeros(len(sub), np.int64)
                for p in np.unique(position).tolist():
                    mine = np.flatnonzero(position == p)
                    entry[mine], error[mine] = held_against(sub[mine], books[p])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry.astype(np.int32)), pa.array(error)], [*batch.schema.names, "now", "error"])

        return written(mapped(members, again, MEMBERS + ", now int, error long"), name)

    members = at_owners(mapped(rows.select("row", "v"), cut, MEMBERS), "members")
    for i in range(1, rounds + 1):
        books = next_books(members, books)
        held = kept_or_moved(members, books, f"held{i}")
        if i < rounds:
            change = F.col("now") != F.col("entry")
            moved = at_owners(held.where(change).select("position", F.col("now").alias("entry"), "row", "part"), f"moved{i}")
            members = held.where(~change).select(*members.columns).unionByName(moved)
    if not rounds:
        held = kept_or_moved(members, books, "held")
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "now"))), lambda x: F.lpad(F.lower(F.hex(x["now"])), 2, "0")), "")
    codes = held.groupBy("row").agg(code.alias("code"), F.sum("error").alias("error"))
    codes = written(rows.select("row", "vec_id", "label").join(codes, "row"), "codes")
    by_label = sent(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    said = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
