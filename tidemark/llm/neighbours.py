"""Approximate nearest neighbours by learned partitions, by largest inner product.

On a bounded sample a graph joins each vector to its nearest ones; the graph is cut into parts of nearly one size with few
edges between parts, and a small network learns to tell from a vector alone in which parts its neighbours lie. The network
then deals every row of the table out to its most probable part, and sends a query to the most probable few. How many these
are is measured: for a few queries all rows are looked at, and the least number of parts is taken that holds enough of
their true answers. In a part, rows are reranked by their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import mapped, sent, with_id, written
from tidemark.shipping import ship

#: Rows that the graph and the network are fitted on, by hash of the row; all others are only dealt out.
SAMPLE = 16_384
#: Parts: a power of two, about one for so many rows, at least and at most so many.
ROWS_A_PART, PARTS = 4096, (16, 1024)
#: Queries, by hash, whose answers among all rows tell how many parts a query is sent to; the share of the answers to be held.
MEASURED, RECALL = 512, 0.94
#: Edges of a vector in the graph.
EDGES = 20
#: Hidden units and passes over the sample of the network.
HIDDEN, EPOCHS = 64, 30
#: Rows of a part, and queries sent to it, that are held against each other at a time.
SLICE = 1 << 16


def dense(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of d doubles; shorter vectors count as ended by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(offsets)
    if len(size) and (size == d).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, d).astype(np.float64)
    out = np.zeros((len(column), d))
    for i in range(len(column)):
        out[i, : size[i]] = values[offsets[i] : offsets[i + 1]]
    return out


def usable(vector: Column) -> Column:
    """Whether a vector isn't null or zero and holds finite components only."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, edges: int) -> np.ndarray:
    """For each row the edges rows of largest inner product, itself left out."""
    out = np.empty((len(x), edges), np.int64)
    single = x.astype(np.float32)
    for b in range(0, len(x), 512):
        s = single[b : b + 512] @ single.T
        s[np.arange(len(s)), np.arange(b, b + len(s))] = -np.inf
        out[b : b + 512] = np.argpartition(-s, edges - 1, axis=1)[:, :edges]
    return out


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """A part of each row: the rows are cut in two at the median of their main direction, and so on; all parts are of one size."""
    label, open_ = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, parts)]
    while open_:
        rows, first, n = open_.pop()
        if n == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ main, kind="stable")]
        open_ += [(order[: len(rows) // 2], first, n // 2), (order[len(rows) // 2 :], first + n // 2, n // 2)]
    return label


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Parts of nearly one size with few edges between them: from halves, vertices move to the part of most of their
    neighbours, largest gain first, while that part has room. In each round a random half of them may."""
    n, (label, draw) = len(x), (halved(x, parts), np.random.default_rng(0))
    room = int(np.ceil(n / parts * (1 + slack)))
    tail, head = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    tail, head = np.r_[tail, head], np.r_[head, tail]
    for _ in range(rounds):
        near = np.bincount(tail * parts + label[head], minlength=n * parts).reshape(n, parts)
        best = near.argmax(axis=1)
        gain = near[np.arange(n), best] - near[np.arange(n), label]
        wish = np.flatnonzero((gain > 0) & (draw.random(n) < 0.5))
        size, moved = np.bincount(label, minlength=parts), 0
        for v in wish[np.argsort(-gain[wish], kind="stable")].tolist():
            if size[best[v]] < room:
                size[label[v]] -= 1
                size[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A network of one hidden layer that tells how probable each part is for a vector."""

    centre: np.ndarray
    scale: float
    weights: list[np.ndarray]

    def log_odds(self, v: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(((v - self.centre) * self.scale) @ w1 + b1, 0) @ w2 + b2

    def best(self, v: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, likelier ones first."""
        return np.argsort(-self.log_odds(v), axis=1, kind="stable")[:, :n]


def learned_router(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = 256, rate: float = 3e-3) -> Router:
    """Fits by Adam to the shares of each row's neighbours in each part."""
    draw, (d, parts) = np.random.default_rng(0), (x.shape[1], target.shape[1])
    centre = x.mean(axis=0)
    scale = 1 / max(float(np.sqrt(((x - centre) ** 2).mean())), 1e-300)
    scaled = (x - centre) * scale
    w = [draw.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), draw.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    mean, square = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    steps, step = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for rows in (order[b : b + batch] for b in range(0, len(x), batch)):
            v = scaled[rows]
            h = np.maximum(v @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            err = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (err @ w[2].T) * (h > 0)
            step += 1
            now = rate * (1 - step / (steps + 1))
            for i, g in enumerate((v.T @ back, back.sum(axis=0), h.T @ err, err.sum(axis=0))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                w[i] -= now * (mean[i] / (1 - 0.9**step) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8) + 1e-4 * w[i])
    return Router(centre, scale, w)


def fitted(sample: np.ndarray, parts: int) -> Router:
    """Graph, balanced parts and network of a sample. With too few rows for a graph there is one part."""
    n, d = sample.shape
    edges = min(EDGES, n - 1)
    while parts > 1 and n < 4 * parts:
        parts //= 2
    if parts < 2 or edges < 1:
        return Router(np.zeros(d), 1.0, [np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    graph = neighbour_graph(sample, edges)
    label = balanced_parts(sample, graph, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), edges), label[graph].ravel()), 0.8 / edges)
    target[np.arange(n), label] += 0.2
    return learned_router(sample, target)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed up in the order of the components."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def nearest_here(ids: np.ndarray, queries: np.ndarray, data_ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's index, row's index, score) of each query's k best rows, its own id left out; ties to the smaller id."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    longest = float(np.sqrt((data**2).sum(axis=1).max())) if len(data) else 0.0
    for b in range(0, len(ids) if len(data) else 0, 128):
        q = queries[b : b + 128]
        s = q @ data.T
        s[data_ids[None, :] == ids[b : b + 128, None]] = -np.inf
        least = np.partition(s, len(data) - k, axis=1)[:, len(data) - k] if len(data) > k else np.full(len(q), -np.inf)
        # products of matrices round in another order: all that may be among the best are told apart by exact sums
        least = least - 1e-12 * (np.abs(least, where=np.isfinite(least), out=np.zeros_like(least)) + np.sqrt((q**2).sum(axis=1)) * longest)
        at, row = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        score = exact(q[at], data[row])
        order = np.lexsort((data_ids[row], -score, at))
        at, row, score = at[order], row[order], score[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((at[kept] + b, row[kept], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def measured_parts(rows: DataFrame, router: Router, d: int, k: int) -> int:
    """The least number of most probable parts that hold RECALL of the true answers of MEASURED queries, all rows looked at."""
    asked = rows.where("asks").orderBy(F.xxhash64("id", "v"), "id").limit(MEASURED).select("id", "v").toArrow()
    ids, queries = asked["id"].to_numpy(), dense(asked["v"], d)
    if not len(ids):
        return 1

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query, id, score, part
        for batch in batches:
            if not batch.num_rows:
                continue
            data, data_ids = dense(batch.column(1), d), batch.column(0).to_numpy()
            q, row, score = nearest_here(ids, queries, data_ids, data, k)
            held = [np.r_[a, b] for a, b in zip(held, (q, data_ids[row], score, router.best(data, 1)[row, 0]), strict=True)]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [c[order] for c in held]
            held = [c[np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k] for c in held]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["q", "id", "score", "part"])

    found = mapped(rows.select("id", "v"), looked_at, "q long, id long, score double, part long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    pairs = best.select("q", "part").toArrow()  # k rows for each of MEASURED queries at most
    place = np.argsort(np.argsort(-router.log_odds(queries), axis=1, kind="stable"), axis=1)[pairs["q"].to_numpy(), pairs["part"].to_numpy()]
    return int(np.quantile(place, RECALL, method="inverted_cdf")) + 1 if len(place) else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by inner product, ties to the smaller id.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without an id, take no part. A row's
    own id is never its answer; of repeated query ids the largest vector asks, repeated candidates count each. Shorter
    vectors count as ended by zeros. With no candidates a query has no rows; an empty table gives none. Other columns are ignored.
    """
    id_, vector = vectors[id_col], vectors[vector_col]
    rows = written(vectors.select(id_.cast("long").alias("id"), is_query.alias("asks"), vector.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))), "vectors")
    total, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    wanted = parts or min(max(PARTS[0], 1 << (total // ROWS_A_PART).bit_length()), PARTS[1])
    taken = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").toArrow()
    router = fitted(dense(taken["v"], d), wanted)
    few = measured_parts(rows, router, d, k)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            part = router.best(dense(v, d), 1)[:, 0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(part.astype(np.int32))], ["id", "v", "part"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = router.best(dense(batch.column(1), d), few) if batch.num_rows else np.zeros((0, 1), np.int64)
            at = pa.array(np.repeat(np.arange(len(best)), best.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(best.ravel().astype(np.int32))], ["id", "v", "part"])

    schema = with_id(rows.select("id", "v"), "v", "part int")
    schema = StructType.fromDDL("id long").add(schema["v"]).add(schema["part"])
    data = written(mapped(rows.select("id", "v"), dealt, schema), "dealt")
    asked = written(mapped(rows.where("asks").groupBy("id").agg(F.max("v").alias("v")), routed, schema), "asked")
    # a part of many rows or queries is cut into slices and blocks of them, each pair of which is a task's work
    slices = data.groupBy("part").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    cuts = sent(slices.join(asked.groupBy("part").agg(F.ceil(F.count("*") / SLICE).alias("blocks")), "part"), "cuts")  # a row for each part
    any_of = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    data = data.join(cuts, "part").withColumn("slice", any_of("slices")).select("part", "slice", each("blocks").alias("block"), "id", "v")
    asked = asked.join(cuts, "part").withColumn("block", any_of("blocks")).select("part", each("slices").alias("slice"), "block", "id", "v")

    def reranked(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data_ids = left["id"].to_numpy(), right["id"].to_numpy()
        q, row, score = nearest_here(ids, dense(left["v"], d), data_ids, dense(right["v"], d), k)
        return pa.table({"query_id": pa.array(ids[q], pa.int64()), "vec_id": pa.array(data_ids[row], pa.int64()), "score": pa.array(score, pa.float64())})

    ship(rows.sparkSession)
    keys = ("part", "slice", "block")
    local = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(reranked, "query_id long, vec_id long, score double")
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
