"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, mapped, texts, with_id, written

KEPT_CHAR = regex.compile(r"[\p{L}\p{M}]")
#: The first code point that isn't told apart: no assigned letter lies at or beyond it but in private use.
LAST_CODE = 0x33480
LETTER = regex.compile(r"\p{L}")
#: Lengths of n-grams, and bits of their hash.
SIZES, BITS = (1, 2, 3), 15
#: Different documents of each language that the fit takes, about, by hash of id and text. Counts for the IDF are of all documents.
SAMPLE_ROWS = 1_000
#: Languages that are learned at most, those with most documents: weights are dense in memory, a number for each and each bucket.
MOST_LANGUAGES = 256
#: The learner's step sizes and elastic-net penalties, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.01, 3
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter or mark, else a space; higher code points count as spaces."""
    out = np.full(LAST_CODE + 1, 32, np.uint64)
    for c in range(LAST_CODE):
        if KEPT_CHAR.match(t := chr(c)) and not 0xD800 <= c < 0xE000:
            out[c] = ord(low) if len(low := t.lower()) == 1 else c
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(bucket, count) of a text's n-grams over lower-case letters, words apart by one space; None without any letter."""
    if not LETTER.search(text):
        return None
    codes = letter_table()[np.minimum(np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32), LAST_CODE)]
    space = codes == 32
    codes = codes[~(space & np.r_[False, space[:-1]])]
    parts = []
    for size in SIZES:
        n = len(codes) - size + 1
        if n > 0:
            h = codes[:n] * FACTORS[0]
            for k in range(1, size):
                h += codes[k : k + n] * FACTORS[k]
            h ^= h >> np.uint64(29)
            parts.append(((h * FACTORS[2] + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.uint16))
    found = np.sort(np.concatenate(parts), kind="stable")
    at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    return found[at].astype(np.int64), np.diff(np.r_[at, len(found)])


def weighted(bucket: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + log count) * idf, of length 1."""
    x = (1 + np.log(count)) * idf[bucket]
    return x / max(1e-12, float(np.sqrt(x @ x)))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def scores(self, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = weighted(bucket, count, self.idf) @ self.weights[bucket] / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray) -> Model:
    """Per-coordinate FTRL with L1 and L2 penalties, on four fifths; the temperature is the one of least loss on the rest."""
    k = len(languages)
    z, n = np.zeros((len(idf), k)), np.zeros((len(idf), k))

    def weights(b: np.ndarray | slice) -> np.ndarray:
        zb, nb = z[b], n[b]
        return np.where(np.abs(zb) <= L1, 0.0, -(zb - np.sign(zb) * L1) / ((BETA + np.sqrt(nb)) / ALPHA + L2))

    rows = [(b, weighted(b, c, idf), y) for b, c, y in examples]
    order = np.random.default_rng(3).permutation(len(rows))
    learn, rest = [i for i in order if i % 5], [i for i in order if i % 5 == 0]
    for _ in range(EPOCHS):
        for i in learn or rest:
            b, x, y = rows[i]
            w = weights(b)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / ALPHA
            z[b] += g - step * w
            n[b] += g * g
    final = weights(slice(None))
    held = [(x @ final[b], y) for b, x, y in (rows[i] for i in rest)]

    def loss(t: float) -> float:
        return sum(float(np.log(np.exp((s - s.max()) / t).sum()) - (s[y] - s.max()) / t) for s, y in held)

    temperature = min((2.0 ** (e / 4) for e in range(-24, 25)), key=loss) if held else 1.0
    return Model(languages, idf, final.astype(np.float32), temperature)


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model, from text and lang of documents that may be learned from, null languages left out.

    Document frequencies are of all of these; what a task sends is a count for each bucket. The fit takes about
    sample_rows documents of each language, those whose hash is below the language's share, repeated ones once, and
    knows MOST_LANGUAGES at most.
    """
    rows = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~held_out(docs[id_col])).select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES), "languages")
    languages = sorted(r.lang for r in counts.collect())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << BITS) + 1, np.int64)  # the last: documents
        for batch in batches:
            for text in texts(batch):
                if (g := grams(text)) is not None:
                    n[g[0]] += 1
                    n[-1] += 1
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["bucket", "n"])

    df = mapped(rows.select("text"), frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((1 << BITS) + 1)
    n[df["bucket"].to_numpy()] = df["n"].to_numpy()
    idf = np.log((1 + n[-1]) / (1 + n[:-1])) + 1
    if not languages:
        return Model([], idf, np.zeros((len(idf), 0), np.float32), 1.0)
    h = F.xxhash64("id", "text")
    share = F.broadcast(counts.select("lang", (F.lit(float(sample_rows)) / F.col("n")).alias("share")))  # a row for each language
    sample = rows.join(share, "lang").where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    sample = sample.groupBy(h.alias("id"), "lang").agg(F.max("text").alias("text")).select("id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [g if (g := grams(t)) is not None else (np.zeros(0, np.int64),) * 2 for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())), batch.column(2)], ["id", "bucket", "count", "lang"])

    found = mapped(sample, run, "id long, bucket array<int>, count array<int>, lang string").toArrow()
    place = {c: j for j, c in enumerate(languages)}
    keys = list(zip(found["id"].to_pylist(), found["lang"].to_pylist(), strict=True))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    examples = [(np.asarray(found["bucket"][i].values), np.asarray(found["count"][i].values), place[keys[i][1]]) for i in order]
    return fit([e for e in examples if len(e[0])], languages, idf)


def language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of docs, from whole texts alone, no shuffle.

    Null texts and texts without a letter are und, with score 0; so is everything if no language was learned. Repeated
    rows and null ids are kept as they are. Columns beside the two are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for text in texts(batch):
                if not m.languages or (g := grams(text)) is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = m.scores(*g)
                best = int(p.argmax())
                names.append(m.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return mapped(rows, run, with_id(docs, id_col, "lang_pred string, score double"))
