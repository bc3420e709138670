"""Exact top-k search: a Voronoi kNN join by largest inner product.

Pivots are data rows of different ids; every vector, asking or not, belongs to its nearest pivot's cell. A query's scores
with the pivots of other ids are scores of real candidates, so the k-th largest bounds its k-th best answer from below. A
cell of queries is summed up by its radius and the least such bound, a cell of data by its radius: the two of them bound
the scores between a pair of cells, and pairs that can't reach the bound are left out whole. In other pairs a data row is
needed by the cell of queries if pivot * row + radius * |row| reaches the bound.
Rows go only to the groups of cells that need them, in slices, are solved there, and the slices' answers are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mapped, written
from tidemark.shipping import ship

#: Pivots: as many as half the root of the rows, and at least and at most so many, which bounds what the driver holds.
PIVOTS = 128, 4096
#: Queries that are solved together, and data rows that are held against them at a time.
GROUP, SLICE = 2048, 8192


def quantized(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, null for vectors that are null or hold a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of d numbers; shorter vectors count as ended by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    out = np.zeros((len(column), d), np.int64)
    size = np.diff(offsets)
    if len(size) and (size == d).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, d).astype(np.int64)
    for i in range(len(column)):
        out[i, : size[i]] = values[offsets[i] : offsets[i + 1]]
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: in doubles while these are exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * max(1, a.shape[1]) < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Cells:
    """Pivots, and what assigning and bounding need of them."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.float64)
        self.exact = pivots
        self.square = (self.pivots**2).sum(axis=1)

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row, and the distance, a little enlarged for rounding."""
        x = v.astype(np.float64)
        near = (self.square - 2 * (x @ self.pivots.T)).argmin(axis=1)
        return near, np.sqrt(((x - self.pivots[near]) ** 2).sum(axis=1)) * (1 + 1e-9)


def answers(ids: np.ndarray, queries: np.ndarray, data_ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best rows here, its own id left out; ties to the smaller id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    by_id = np.argsort(data_ids, kind="stable")
    data_ids, data = data_ids[by_id], data[by_id]
    for begin in range(0, len(ids), 256):
        s = scores(queries[begin : begin + 256], data)
        for q, row in zip(ids[begin : begin + 256].tolist(), s, strict=True):
            allowed = np.flatnonzero(data_ids != q)
            row = row[allowed]
            if len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                over = np.flatnonzero(row > least)
                keep = np.r_[over, np.flatnonzero(row == least)[: k - len(over)]]
            else:
                keep = np.arange(len(row))
            out.append((np.full(len(keep), q), data_ids[allowed[keep]], row[keep]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with all other rows, ties to the smaller id.

    Components are floor(64 * x). Vectors that are null or hold null or non-finite components, and rows without an id, take
    no part. A row's own id is never its answer; of repeated query ids the largest vector asks, repeated candidates count
    each. Shorter vectors count as ended by zeros. With no candidates a query has no rows. Columns beside the two are ignored.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), is_query.alias("asks"), quantized(vectors[vector_col]).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = written(rows, "vectors")
    total, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    pivots = pivots or min(max(PIVOTS[0], math.isqrt(total) // 2), PIVOTS[1])
    names = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(pivots)
    picked = rows.join(F.broadcast(names), "id").groupBy("id").agg(F.max("v").alias("v")).toArrow()
    d = max(1, d)
    cells = Cells(matrix(picked["v"], d) if total else np.zeros((1, d), np.int64))
    pivot_ids = picked["id"].to_numpy() if total else np.zeros(0, np.int64)
    m = len(pivot_ids)
    spark = rows.sparkSession
    queries = rows.where("asks").groupBy("id").agg(F.max("v").alias("v"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), d)
            cell, far = cells.of(v)
            none = np.iinfo(np.int64).min
            best = np.sort(np.where(batch.column(0).to_numpy()[:, None] == pivot_ids, none, scores(v, cells.exact)), axis=1) if m >= k else None
            least = np.full(len(v), none) if best is None else best[:, -k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(least)], ["id", "v", "cell", "far", "least"])

    queries = written(mapped(queries.select("id", "v"), bounded, "id long, v array<long>, cell int, far double, least long"), "queries")
    known = queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.min("least").alias("least")).collect()  # a row for each pivot at most
    # cells along the pivots' main direction are packed to groups of queries; a large cell takes several
    axis = np.linalg.svd(cells.pivots - cells.pivots.mean(axis=0), full_matrices=False)[2][0] if m > 1 else np.ones(d)
    order = sorted(known, key=lambda r: (float(cells.pivots[r.cell] @ axis), r.cell))
    first, parts, group, held = {}, {}, 0, 0
    for r in order:
        if held and held + r.n > GROUP:
            group, held = group + 1, 0
        first[r.cell], parts[r.cell] = group, -(-r.n // GROUP)
        held += r.n
        if r.n > GROUP:
            group, held = group + parts[r.cell], 0
    cell_of = np.array([r.cell for r in known], np.int64)
    radius = np.array([r.radius for r in known], np.float64)
    least = np.array([float(r.least) for r in known], np.float64)
    groups_of = [list(range(first[r.cell], first[r.cell] + parts[r.cell])) for r in known]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = cells.of(matrix(batch.column(0), d))
            most = np.full(len(cells.exact), -1.0)
            np.maximum.at(most, cell, far)
            here = np.flatnonzero(most >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(most[here])], ["cell", "far"])

    width = np.full(len(cells.exact), -1.0)  # radius of each cell of data
    for r in mapped(rows.select("v"), spread, "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row for each pivot at most
        width[r.cell] = r.far
    centre, length = cells.pivots[cell_of], np.sqrt(cells.square)
    between, rest = cells.pivots @ centre.T, np.outer(length, radius) + np.outer(width, length[cell_of]) + np.outer(width, radius)
    meets = between + rest + 1e-6 * (np.abs(between) + rest) + 1 >= least  # by cell of data, then of queries

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), d).astype(np.float64)
            if not len(cell_of):
                continue
            cell, far = cells.of(v)
            norm = np.sqrt((v**2).sum(axis=1))
            reach = np.zeros((len(v), len(cell_of)), bool)
            for c in np.unique(cell).tolist():
                mine = np.flatnonzero(cell == c)
                # a row on the edge of two cells may have been told to the other one: then its own cell's radius doesn't hold
                asks = np.flatnonzero(meets[c]) if far[mine].max() <= width[c] else np.arange(len(cell_of))
                most = v[mine] @ centre[asks].T + np.outer(norm[mine], radius[asks])
                reach[np.ix_(mine, asks)] = most + 1e-6 * np.abs(most) + 1 >= least[asks]
            row, group = [], []
            for i, hit in enumerate(reach):
                to = {g for c in np.flatnonzero(hit).tolist() for g in groups_of[c]}
                row += [i] * len(to)
                group += to
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], ["group", "id", "v"])

    data = written(mapped(rows.select("id", "v"), needed, "group int, id long, v array<long>"), "data")
    # a row for each group of queries, which have GROUP queries each and so are few against the rows
    dealt = written(data.groupBy("group").agg(F.ceil(F.count("*") / SLICE).alias("slices")), "slices")
    data = data.withColumn("row", F.monotonically_increasing_id()).join(dealt, "group")  # any slice will do, so that equal rows part
    data = data.select("group", F.pmod(F.xxhash64("row"), F.col("slices")).alias("slice"), "id", "v")
    starts = spark.createDataFrame(pd.DataFrame({"cell": pd.Series(list(first), dtype="int32"), "first": pd.Series(list(first.values()), dtype="int32"), "parts": pd.Series([parts[c] for c in first], dtype="int32")}), "cell int, first int, parts int")
    asked = queries.join(F.broadcast(starts), "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("group"), "id", "v")
    asked = asked.join(dealt, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "id", "v")

    def solved(left: pa.Table, right: pa.Table) -> pa.Table:
        q, i, s = answers(left["id"].to_numpy(), matrix(left["v"], d), right["id"].to_numpy(), matrix(right["v"], d), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    ship(spark)
    local = asked.groupBy("group", "slice").cogroup(data.groupBy("group", "slice")).applyInArrow(solved, "query_id long, vec_id long, score long")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
