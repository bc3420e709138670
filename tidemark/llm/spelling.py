"""Spelling variant grouping by a frequency-vector trie.

A word's frequency vector counts its letters by groups of letters. One inserted letter adds one to a count, a deleted one
takes one away, a replaced one does both or neither: words that are near have vectors of a surplus and a deficit of one at
most. A trie arranges words by their first group's count, then by the second's, and so on; a depth-first search goes down it
with the words that still have budget for each branch, and words in the leaves they reach are verified letter by letter.

The trie's top is cut where few enough words are below, by counts of words by prefix, one level at a time; each cut is a
subtrie that one task builds. Of two near words one is sent to the other's subtrie: nearness has no direction, so of
two subtries only one side's words ask the other. Tasks give a word's near words as a number and the best one, never as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mapped, sent, written
from tidemark.shipping import ship

LETTERS = r"A-Za-zÀ-ÿ"
#: Groups of letters: a letter's code point modulo this.
GROUPS = 16
#: Words of a subtrie; one that can't be cut further is dealt out in slices of so many.
SUBTRIE = 16_384
#: Words that ask one task's subtrie, times its size.
ASKED = 4
#: What a word does in a subtrie: it lives there, or asks, or both.
LIVES_AND_ASKS, LIVES, ASKS = 0, 1, 2
#: Words below which a trie's node isn't branched further.
LEAF = 256
#: Pairs, or letters of pairs, that are looked at a time, and pairs within their budgets that are held until they are verified.
BLOCK, HELD = 1 << 20, 1 << 17


def run_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", every: int = 31, least: int = 7) -> DataFrame:
    """(word): each run of letters, A-Z in lower case. Where every divides the checksum h of `<id>:<run>`, the letter h % length
    is left out. Words of fewer than least letters aren't told, and runs of fewer can't give longer ones."""
    upper = "".join(map(chr, range(65, 91)))
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("of"), F.explode(F.regexp_extract_all(docs[text_col], F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.select("of", F.translate("run", upper, upper.lower()).alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "of", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least)


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters, starts): all words' code points in a row, a byte each, and where each word begins, with the end."""
    data = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def picked(letters: np.ndarray, starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """letters_of() some of the words."""
    size = np.diff(starts)[words]
    ends = np.cumsum(size)
    return letters[np.repeat(starts[words] - (ends - size), size) + np.arange(size.sum())], np.r_[0, ends]


def frequencies(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The frequency vector of each word."""
    n = len(starts) - 1
    word = np.repeat(np.arange(n), np.diff(starts))
    return np.bincount(word * GROUPS + letters % GROUPS, minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)


def group_counts(word: Column, groups: int) -> list[Column]:
    """The first counts of the frequency vector, as columns."""
    every = [*range(97, 123), *range(0xC0, 0x100)]
    return [F.length(word) - F.length(F.translate(word, "".join(chr(c) for c in every if c % GROUPS == g), "")) for g in range(groups)]


@dataclass
class Cut:
    """A node at which the trie is cut: the counts that lead to it, and the number of its slices."""

    prefix: tuple[int, ...]
    slices: int


def cut_trie(words: DataFrame, size: int) -> list[Cut]:
    """The trie's cuts, in the order of a depth-first search. Each level counts the words below the nodes that are too large yet, so
    what comes to the driver is some rows for every size words."""
    cuts, large = [], [()]
    for level in range(1, GROUPS + 1):
        counts = group_counts(F.col("word"), level)
        below = words.select(F.array(*counts).alias("prefix"))
        if level > 1:
            below = below.join(F.broadcast(words.sparkSession.createDataFrame([(list(p),) for p in large], "above array<int>")), F.slice("prefix", 1, level - 1) == F.col("above"))
        found = [(tuple(r.prefix), r["count"]) for r in below.groupBy("prefix").count().collect()]
        cuts += [Cut(p, -(-n // size)) for p, n in found if n <= size or level == GROUPS]
        large = [p for p, n in found if n > size and level < GROUPS]
        if not large:
            break
    return sorted(cuts, key=lambda c: c.prefix)


class Top:
    """The trie above the cuts."""

    def __init__(self, cuts: list[Cut]):
        self.first = np.cumsum([0, *(c.slices for c in cuts)])
        self.slices = np.array([c.slices for c in cuts], np.int64)
        self.root: dict = {}
        for i, c in enumerate(cuts):
            node = self.root
            for count in c.prefix[:-1]:
                node = node.setdefault(count, {})
            node[c.prefix[-1]] = i

    def reached(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, cut, own): the cuts that words reach with a surplus and a deficit of one, and whether without any."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]

        def visit(node: dict | int, level: int, word: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
            if isinstance(node, int):
                out.append((word, np.full(len(word), node), (surplus == 0) & (deficit == 0)))
                return
            for count, child in node.items():
                more = count - vectors[word, level]
                s, d = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
                alive = (s <= 1) & (d <= 1)
                if alive.any():
                    visit(child, level + 1, word[alive], s[alive], d[alive])

        if len(vectors):
            none = np.zeros(len(vectors), np.int32)
            visit(self.root, 0, np.arange(len(vectors)), none, none)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words, rows of letters, differ by exactly one edit; b's are as long as a's or by one longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    differs = np.c_[a != b[:, :n], np.ones(len(a), bool)].argmax(axis=1)
    return ((a != b[:, 1:]) & (np.arange(n) >= differs[:, None])).sum(axis=1) == 0


class Subtrie:
    """A trie of words, searched depth first by many words at once."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray):
        self.letters, self.starts = letters, starts
        vectors = frequencies(letters, starts)
        self.order = np.lexsort(vectors.T[::-1])
        self.sorted = vectors[self.order]

    def near(self, letters: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asking word, word here) of all words that differ by one edit."""
        asking = frequencies(letters, starts)
        none = np.zeros(len(asking), np.int32)
        open_ = [(0, len(self.order), 0, np.arange(len(asking)), none, none)]
        held, n = [], 0
        while open_:
            low, high, level, word, surplus, deficit = open_.pop()
            if high - low <= LEAF or level == GROUPS:
                for pairs in self.within_budget(asking, word, low, high):
                    held.append(pairs)
                    n += len(pairs[0])
                    if n >= HELD:
                        yield from self.verified(letters, starts, *(np.concatenate(c) for c in zip(*held, strict=True)))
                        held, n = [], 0
                continue
            counts = self.sorted[low:high, level]
            for count in np.unique(counts).tolist():
                more = count - asking[word, level]
                s, d = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
                alive = np.flatnonzero((s <= 1) & (d <= 1))
                if len(alive):
                    left, right = np.searchsorted(counts, count), np.searchsorted(counts, count, "right")
                    open_.append((low + left, low + right, level + 1, word[alive], s[alive], d[alive]))
        if held:
            yield from self.verified(letters, starts, *(np.concatenate(c) for c in zip(*held, strict=True)))

    def within_budget(self, asking: np.ndarray, word: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of a leaf's words and those that reached it, the pairs whose counts differ by a surplus and a deficit of one at most: where
        the squared differences sum up to two at most and the differences to one."""
        here = self.sorted[low:high].astype(np.float64)
        own, size = (here**2).sum(axis=1), here.sum(axis=1)
        for b in range(0, len(word), max(1, BLOCK // (high - low))):
            q = word[b : b + max(1, BLOCK // (high - low))]
            v = asking[q].astype(np.float64)
            at, w = np.nonzero((v**2).sum(axis=1)[:, None] + own - 2 * (v @ here.T) <= 2)
            fits = np.abs(v.sum(axis=1)[at] - size[w]) <= 1
            yield q[at[fits]], self.order[low + w[fits]]

    def verified(self, letters: np.ndarray, starts: np.ndarray, q: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs that differ by one edit, letter by letter."""
        a, z = np.diff(starts)[q], np.diff(self.starts)[w]
        order = np.lexsort((z, a))
        edges = np.flatnonzero(np.r_[True, (np.diff(a[order]) != 0) | (np.diff(z[order]) != 0), True]) if len(order) else np.zeros(1, np.int64)
        for pair in (order[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            n, m = int(a[pair[0]]), int(z[pair[0]])
            for p in np.array_split(pair, -(-len(pair) * n // BLOCK)):
                left, right = letters[starts[q[p], None] + np.arange(n)], self.letters[self.starts[w[p], None] + np.arange(m)]
                hit = p[one_edit(left, right) if n <= m else one_edit(right, left)]
                yield q[hit], w[hit]


def best_of(of: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, near words, best): for each word of `of` how many others it has, and the one of largest n, first in code-point order."""
    order = np.lexsort((rank[other], -n[other], of))
    words, first, count = np.unique(of[order], return_index=True, return_counts=True)
    return words, count, other[order][first]


def near_words(words: DataFrame, size: int = SUBTRIE) -> DataFrame:
    """(word, n_near, form, form_n) of all words (word, n), different from each other, that have near ones."""
    cuts = cut_trie(words, size)
    if not cuts:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.col("word").alias("form"), F.col("n").alias("form_n")).limit(0)

    def placed(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home of each word, asking word, node that it asks)."""
        letters, starts = letters_of(words)
        size = np.diff(starts)
        word, cut, own = top.reached(frequencies(letters, starts))
        mine = np.empty(len(words), np.int64)
        mine[word[own]] = cut[own]
        # any slice will do, but the same one each time: a checksum of the letters
        sums = np.bincount(np.repeat(np.arange(len(words)), size), letters * (np.arange(len(letters)) - np.repeat(starts[:-1], size) + 1.0) ** 2, len(words))
        home = top.first[mine] + sums.astype(np.int64) % top.slices[mine]
        # of two cuts one side asks the other, now the earlier and now the later one, so that none is asked by all
        asks = np.where((mine[word] + cut) % 2 == 0, cut >= mine[word], cut <= mine[word])
        word, cut = word[asks], cut[asks]
        n = top.slices[cut]
        at = np.repeat(np.arange(len(word)), n)
        node = top.first[cut[at]] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        word, same = word[at], (cut == mine[word])[at]
        # two slices of a cut meet once, and a word finds those that live with it at home
        keep = ~same | (node > home[word])
        return home, word[keep], node[keep]

    top = Top(cuts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(top.first[-1], np.int64)
        for batch in batches:
            asked += np.bincount(placed(batch.column(0))[2], minlength=len(asked))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(asked).astype(np.int32)), pa.array(asked[asked > 0])], ["node", "asked"])

    blocks = np.ones(top.first[-1], np.int64)  # a subtrie that many words ask is built by several tasks, each asked by some of them
    for r in mapped(words.select("word"), counted, "node int, asked long").groupBy("node").agg(F.sum("asked").alias("asked")).collect():  # some rows for every size words
        blocks[r.node] = -(-r.asked // (ASKED * size))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, word, node = placed(batch.column(0))
            n = blocks[home]
            lives = np.repeat(np.arange(len(home)), n)
            block = np.r_[np.arange(len(lives)) - np.repeat(np.cumsum(n) - n, n), np.arange(len(word)) % blocks[node]]
            role = np.r_[np.where(block[: len(lives)] == 0, LIVES_AND_ASKS, LIVES), np.full(len(word), ASKS)]
            take = pa.array(np.r_[lives, word])
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[home[lives], node].astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(role.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], ["node", "block", "role", "word", "n"])

    def searched(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        role, n = rows["role"].to_numpy(), rows["n"].to_numpy()
        words = rows["word"].combine_chunks()
        rank = np.empty(len(n), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(n))
        letters, starts = letters_of(words)
        found, asking = np.flatnonzero(role != ASKS), np.flatnonzero(role != LIVES)
        trie = Subtrie(*picked(letters, starts, found))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, w in trie.near(*picked(letters, starts, asking)):
            q, w = asking[q], found[w]
            new = (role[q] == ASKS) | (q < w)  # pairs of words that live here are seen from both sides
            a.append(q[new])
            b.append(w[new])
        a, b = np.concatenate(a), np.concatenate(b)
        word, count, best = best_of(np.r_[a, b], np.r_[b, a], n, rank)
        return pa.table({"word": words.take(pa.array(word)), "n_near": pa.array(count.astype(np.int64)), "form": words.take(pa.array(best)), "form_n": pa.array(n[best])})

    ship(words.sparkSession)
    sent_out = mapped(words.select("word", "n"), dealt, "node int, block int, role int, word string, n long")
    partial = sent_out.groupBy("node", "block").applyInArrow(searched, "word string, n_near long, form string, form_n long")
    merged = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return merged.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of words (word, form), by pointers doubled until the longest chain is covered: n grows tenfold along a chain,
    so one up to most has few links."""
    found, reach = forms.select("word", F.col("form").alias("root")), 1
    while 10**reach <= most:
        step = sent(found.select(F.col("word").alias("at"), F.col("root").alias("to")), "links", F.length("at") + F.length("to") + 48)
        found = written(found.join(step, F.col("root") == F.col("at"), "left").select("word", F.coalesce("to", "root").alias("root")), "roots")
        reach *= 2
    return found


def spelling_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", times: int = 10, size: int = SUBTRIE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of two occurrences or more, and what they are variants of.

    Near words differ by exactly one inserted, deleted or replaced letter. form is the near word of largest n, ties to the first in
    code-point order, if that n is at least times the word's; root is where forms lead to. Null and empty texts have no words,
    repeated rows count each, a null id counts as the empty text in checksums; words may be of any length. An empty table
    gives no rows. Other columns are ignored.
    """
    words = written(run_words(docs, text_col, id_col).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2"), "words")
    near = written(near_words(words, size), "near")
    joined = written(words.join(near, "word", "left").withColumn("is_form", F.col("form_n") >= times * F.col("n")), "variants")
    forms = joined.where("is_form").select("word", "form")
    most = joined.agg(F.max("form_n")).first()[0] or 1
    led = roots(forms, int(most)).withColumnRenamed("word", "of")
    out = joined.join(led, F.col("word") == F.col("of"), "left")
    formed = lambda c: F.when(F.col("is_form"), F.col(c)).alias(c)
    return out.select("word", formed("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed("form_n"))
