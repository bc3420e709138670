"""Toxicity: a logistic classifier on words and word beginnings, kept even-handed by swapping identity terms.

Each labelled text that names a group has counterfactuals, in which the terms are those of other groups of the same kind.
The fit penalises the squared differences of their scores from the text's, so that a group's name alone moves no score,
whatever the labels of the texts that it stands in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, mapped, texts, with_id, written

WORDS = re.compile(r"[^\W\d_]+")
#: Labelled rows of each class that the fit takes at most, by hash of the id; the only thing that doesn't grow with the data.
SAMPLE_ROWS = 4_000
#: Features of sampled texts and their counterfactuals that the fit holds at most; the sample ends before it has more.
SAMPLE_FEATURES = 16_000_000
#: Counterfactuals of a text, with terms that come after its own in their kinds.
SWAPS_EACH = 3
#: A feature is used if so many sampled texts have it; lengths of word beginnings that are features too.
LEAST_TEXTS, BEGINNINGS = 4, (4, 5, 6)
#: A feature's value is the logarithm of its rarity in the sample over this, 1 at most: frequent words tell little.
RARITY = 4.0
L1, L2, FAIR = 3e-4, 1e-5, 5.0
EPOCHS, BATCH, RATE = 12, 128, 0.3

#: Terms of identity by kind; a term is swapped with others of its line.
IDENTITY = [
    line.split()
    for line in """women men girls boys nonbinary transgender
woman man girl boy
female male
muslims christians jews hindus buddhists sikhs atheists catholics protestants
muslim christian jewish hindu buddhist sikh atheist catholic protestant
black white asian latino hispanic arab african european indigenous
gay straight lesbian bisexual queer heterosexual trans
immigrants refugees foreigners migrants citizens locals
immigrant refugee foreigner migrant citizen local
disabled blind deaf autistic paralyzed able
old young elderly teenage
americans mexicans chinese indians russians germans turks poles
frauen männer mädchen jungen
muslime christen juden
schwarze weiße asiaten araber
schwule lesben heterosexuelle
ausländer flüchtlinge einwanderer bürger
femmes hommes filles garçons
musulmans chrétiens juifs
noirs blancs asiatiques arabes
immigrés réfugiés étrangers citoyens
mujeres hombres niñas niños
musulmanes cristianos judíos
negros blancos asiáticos árabes
inmigrantes refugiados extranjeros ciudadanos""".splitlines()
]

def swaps_of(kinds: list[list[str]]) -> dict[str, list[str]]:
    """For each term, the others of its kind, from the one behind it on. Of several lines with a term, the last counts."""
    return {t: [line[(i + k) % len(line)] for k in range(1, len(line))] for line in kinds for i, t in enumerate(line)}


SWAPS = swaps_of(IDENTITY)


def features(words: set[str]) -> set[int]:
    """31-bit hashes of words, and of their beginnings marked with a star."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return {xxhash.xxh3_64_intdigest(f) & 0x7FFFFFFF for f in out}


def counterfactuals(words: set[str], swaps: dict[str, list[str]] = SWAPS) -> list[set[str]]:
    """The words with every identity term swapped for another of its kind, in up to SWAPS_EACH ways; none without such a term."""
    found = {t for t in words & swaps.keys() if swaps[t]}
    rest = words - found
    return [rest | {swaps[t][k % len(swaps[t])] for t in found} for k in range(min(SWAPS_EACH, max((len(swaps[t]) for t in found), default=0)))]


def encoded(words: set[str]) -> np.ndarray:
    return np.array(sorted(features(words)), np.int32)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(sets: list[np.ndarray], swapped: list[list[np.ndarray]], labels: list[int], odds: float = 0.0, fair: float = FAIR) -> tuple[dict[int, float], float]:
    """(weights of features, intercept) from features, those of the counterfactuals, and labels, by proximal
    steps on batches in a fixed order. odds: log odds of label 1 in the labelled data, less those here, added to the intercept.
    """
    if not sets:
        return {}, 0.0
    y = np.array(labels, float)
    if y.min() == y.max():
        return {}, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) + odds
    names, n_of = np.unique(np.concatenate(sets), return_counts=True)
    names, n_of = names[n_of >= LEAST_TEXTS], n_of[n_of >= LEAST_TEXTS]

    def columns(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(names, s)
        at = at[at < len(names)] if len(names) else at[:0]
        s = s[: len(at)]
        return at[names[at] == s].astype(np.int32)

    rows = [columns(s) for s in sets]
    other = {i: [columns(s) for s in x] for i, x in enumerate(swapped) if x}
    value = np.minimum(1.0, np.log(len(sets) / n_of) / RARITY)
    w, b = np.zeros(len(names)), 0.0
    seen, seen_b = np.full(len(names), 1e-2), 1e-2
    order = np.random.default_rng(5).permutation(len(rows))
    for _ in range(EPOCHS):
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            size = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part])
            at = np.repeat(np.arange(len(part)), size)
            score = logistic(np.bincount(at, (w * value)[flat], len(part)) + b)
            err = (score - y[part]) / len(part)
            grad, grad_b = value * np.bincount(flat, np.repeat(err, size), len(w)), err.sum()
            for k, i in enumerate(part.tolist()):
                for swap in other.get(i, ()):  # the penalty on swaps that change the score
                    there = logistic(w[swap] @ value[swap] + b)
                    diff = 2 * fair * (score[k] - there) / len(part) / len(other[i])
                    here_slope, there_slope = score[k] * (1 - score[k]), there * (1 - there)
                    np.add.at(grad, rows[i], diff * here_slope * value[rows[i]])
                    np.add.at(grad, swap, -diff * there_slope * value[swap])
                    grad_b += diff * (here_slope - there_slope)
            grad += L2 * w
            seen += grad**2
            seen_b += grad_b**2
            rate = RATE / np.sqrt(seen)
            w -= rate * grad
            w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
            b -= RATE / np.sqrt(seen_b) * grad_b
    weight = w * value
    used = np.flatnonzero(weight)
    return dict(zip(names[used].tolist(), weight[used].tolist(), strict=True)), float(b) + odds


class Scorer:
    """The model by word: what a word adds is looked up once for each worker and distinct word."""

    def __init__(self, weights: dict[int, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.known: dict[str, tuple[int, ...]] = {}

    def found(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= 200_000:
            self.known.clear()
        self.known[word] = out = tuple(f for f in features({word}) if f in self.weights)
        return out

    def __call__(self, text: str) -> float:
        get, found = self.known.get, set()
        for word in set(WORDS.findall(text.lower())):
            if hits := self.found(word) if (k := get(word)) is None else k:
                found.update(hits)
        return float(logistic(np.float64(self.intercept + sum(self.weights[f] for f in sorted(found)))))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, identity: list[list[str]] = IDENTITY, fair: float = FAIR) -> tuple[dict[int, float], float]:
    """The model, from at most sample_rows labelled rows of each class that may be learned from, and SAMPLE_FEATURES features.

    Rows are counted in full; the sample is those of least hash, so it is the same at every run. Of an id with several
    labels the largest counts, of one with several texts the greatest. identity: terms that are swapped, by kind.
    """
    swaps = swaps_of(identity)
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isin(0, 1) & ~held_out(labels[id_col])).groupBy(labels[id_col].alias("id")).agg(F.max(label_col).alias("y"))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for y in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most twice sample_rows
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(sample, "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [set(WORDS.findall(t.lower())) for t in texts(batch)]
            found, swapped = [encoded(w) for w in words], [[encoded(c) for c in counterfactuals(w, swaps)] for w in words]
            size = [len(f) + sum(map(len, s)) for f, s in zip(found, swapped, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32()))), pa.array(size, pa.int64()), batch.column(2)], ["id", "found", "swapped", "size", "y"])

    kind = rows.schema["id"].dataType.simpleString()
    found = written(mapped(rows.select("id", "text", "y"), run, f"id {kind}, found array<int>, swapped array<array<int>>, size long, y int"), "sample")
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row for each sampled id
    fits = F.broadcast(found.select("id", so_far.alias("so_far")).where(F.col("so_far") <= SAMPLE_FEATURES).select("id"))
    found = found.join(fits, "id", "left_semi").drop("size").toArrow()
    ids, labels_of = found["id"].to_pylist(), found["y"].to_pylist()
    sets = [np.asarray(x.values) for x in found["found"]]
    swapped = [[np.asarray(x.values) for x in s.values] for s in found["swapped"]]
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    ones = sum(labels_of)
    odds = np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)) - np.log((ones + 1) / (len(ids) - ones + 1))
    return fit([sets[i] for i in order], [swapped[i] for i in order], [labels_of[i] for i in order], float(odds), fair)


def toxicity(docs: DataFrame, model: tuple[dict[int, float], float], threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row of docs, from whole texts alone, no shuffle. The id can be of any type.

    Null and empty texts have the score of a text without known words. Repeated rows and null ids are kept. Columns
    beside the two are ignored. Terms of identity that the fit hasn't met have no weight.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(*shared.value)
        for batch in batches:
            s = np.array([score(t) for t in texts(batch)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return mapped(rows, run, with_id(docs, id_col, "score double, predicted int"))
