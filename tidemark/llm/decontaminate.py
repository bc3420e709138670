"""Benchmark decontamination: an FM-index per shard of training text, searched backwards for every benchmark window."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_words, hashed_texts, mapped, mixed, texts, with_id, written

#: Words in a window; an item with fewer is one window.
WINDOW = 13
#: Every so many positions of a shard's text, the index keeps where a suffix starts.
SAMPLE = 16
#: Words of documents that share an index; a longer document has one of its own.
SHARD_WORDS = 1_000_000
#: Bytes of benchmark texts that are searched for in one pass over the documents.
BLOCK_BYTES = 16_000_000
#: Occurrences that are located at a time.
CHUNK = 1 << 20

#: Words are runs of digits, a-z and all beyond ASCII, after A-Z are lower-cased: as UTF-8 bytes, with all else as spaces.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LOWER_STR = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling: suffixes that share a rank are sorted by the rank so many positions on."""
    n, k = len(text), 1
    same = np.unique(text, return_inverse=True)[1]
    counts = np.bincount(same)
    rank = (np.cumsum(counts) - counts)[same]  # a group's rank is its first row
    active = np.flatnonzero(counts[same] > 1)
    while len(active):
        ahead = active + k
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        first = rank[active]
        new_group = np.r_[True, key[1:] != key[:-1]]
        new_parent = np.r_[True, first[1:] != first[:-1]]
        at = np.arange(len(active))
        parent_at = np.maximum.accumulate(np.where(new_parent, at, 0))
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        rank[active] = first + group_at - parent_at
        size = np.diff(np.r_[np.flatnonzero(new_group), len(active)])
        active = active[np.repeat(size > 1, size)]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Bits:
    """A bit vector with ranks by counted words of 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks of symbols in a sequence: a level for each bit, highest first, each stably parted by that bit."""

    def __init__(self, symbols: np.ndarray):
        self.levels = []
        for shift in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            zeros = int((bit == 0).sum())
            self.levels.append((shift, Bits(bit.astype(np.uint8)), zeros))
            symbols = np.r_[symbols[bit == 0], symbols[bit == 1]]

    def rank(self, symbol: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each of its positions."""
        where = [np.zeros(len(symbol), np.int64), *at]
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            where = [np.where(one, zeros + (r := bits.rank(i)), i - r) for i in where]
        return [i - where[0] for i in where[1:]]

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, r = bits.get(i), bits.rank(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + r, i - r)
        return symbol


class FMIndex:
    """Of a text of symbols from 1; the index adds 0 as its end."""

    def __init__(self, text: np.ndarray):
        text = np.r_[text, 0].astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1])
        self.first = np.r_[0, np.cumsum(np.bincount(text))]
        kept = order % SAMPLE == 0
        self.marked, self.samples = Bits(kept.astype(np.uint8)), order[kept]

    def search(self, flat: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of those patterns, each flat[start : start + size], that occur, by backward search for all at once."""
        which = np.arange(len(starts))
        for column in range(size):
            which = which[flat[starts[which] + column] < len(self.first) - 1]
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        for column in range(size - 1, -1, -1):
            c = flat[starts[which] + column].astype(np.int64)
            low, high = (self.first[c] + r for r in self.tree.rank(c, low, high))
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: each steps back through the text until a row whose position was kept."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            found = self.marked.get(rows)
            out[left[found]] = self.samples[self.marked.rank(rows[found])] + steps
            left, rows = left[~found], rows[~found]
            c = self.tree.at(rows)
            rows = self.first[c] + self.tree.rank(c, rows)[0]
            steps += 1
        return out


class Windows:
    """The windows of benchmark items, by length: all words in one array, and where each distinct window starts in it, with its items.

    Arrays of about 30 bytes for each word; windows are told apart by 64-bit hashes, as words are.
    """

    def __init__(self, items: list[tuple[str | None, str]]):
        known = [(name, hashes) for name, text in items if len(hashes := hash_words(text.encode().translate(TO_WORDS))[1])]
        self.names = [name for name, _ in known]
        self.words = np.unique(np.concatenate([h for _, h in known])) if known else np.zeros(0, np.uint64)
        sizes = np.array([min(WINDOW, len(h)) for _, h in known], np.int64)
        self.shortest = int(sizes.min()) if known else 0
        self.by_length = []
        for size in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == size)
            length = np.array([len(known[i][1]) for i in mine.tolist()])
            flat = np.concatenate([self.numbered(known[i][1]) for i in mine.tolist()]).astype(np.int32)
            count = length - size + 1
            starts = np.arange(count.sum()) + np.repeat(np.cumsum(length) - length - np.cumsum(count) + count, count)
            key = np.zeros(len(starts), np.uint64)
            for column in range(size):
                key = mixed(key + flat[starts + column].astype(np.uint64) + np.uint64(column + 1))
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            pairs = np.unique(inverse * len(mine) + np.repeat(np.arange(len(mine)), count))
            self.by_length.append((size, flat, starts[first], np.searchsorted(pairs, np.arange(len(first) + 1) * len(mine)), mine[pairs % len(mine)]))

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, from 2; 0 for words that no window has."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 2, 0)


def shard_hits(texts_: list[str], windows: Windows) -> list[tuple[int, np.ndarray, set[int]]]:
    """(words, spans of hit words as rows of start and end, items) of each text, all in one index.

    Words that no window has become one separator, as do stretches between them that are shorter than any window: no
    window occurs across or in them. So the index holds what can match, and each symbol's place in the shard beside it.
    """
    parts, sizes = [], []
    for _, bounds, hashes in hashed_texts(texts_, TO_WORDS):
        numbers = windows.numbered(hashes)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            sizes.append(b - a)
            parts += [numbers[a:b], np.zeros(1, np.int64)]
    starts = np.cumsum([0, *(n + 1 for n in sizes)])
    shard = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    hit = np.zeros(len(shard) + 1, np.int64)
    items: list[set[int]] = [set() for _ in texts_]
    known = np.r_[0, (shard > 0).astype(np.int8), 0]
    edges = np.diff(known)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - begins >= max(1, windows.shortest)
    begins, ends = begins[long], ends[long]
    if len(begins):
        lengths = ends - begins + 1  # and a separator
        base = np.repeat(begins - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
        place = np.arange(lengths.sum()) + base
        symbols = shard[np.minimum(place, len(shard) - 1)]
        symbols[np.cumsum(lengths) - 1] = 1
        index = FMIndex(symbols)
        for size, flat, patterns, begins_of, of in windows.by_length:
            which, low, high = index.search(flat, patterns, size)
            counts = high - low
            total = np.cumsum(counts)
            begin = 0
            while begin < len(which):  # whole windows, about CHUNK occurrences at a time
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + CHUNK)))
                n = counts[begin:end]
                rows = np.arange(n.sum()) + np.repeat(low[begin:end] - np.r_[0, np.cumsum(n)[:-1]], n)
                at = place[index.locate(rows)]
                np.add.at(hit, at, 1)
                np.add.at(hit, at + size, -1)
                doc = np.searchsorted(starts, at, side="right") - 1
                pairs = np.unique(doc * len(patterns) + np.repeat(which[begin:end], n))
                for d, w in zip((pairs // len(patterns)).tolist(), (pairs % len(patterns)).tolist(), strict=True):
                    items[d].update(of[begins_of[w] : begins_of[w + 1]].tolist())
                begin = end
    covered = np.r_[0, (np.cumsum(hit[:-1]) > 0).astype(np.int8), 0]
    edges = np.diff(covered)
    spans = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1)  # touching occurrences are one span
    cut = np.searchsorted(spans[:, 0], starts)
    return [(sizes[i], spans[cut[i] : cut[i + 1]] - starts[i], items[i]) for i in range(len(texts_))]


def shards(batch_texts: list[str]) -> Iterator[slice]:
    """Parts of a batch of about SHARD_WORDS words each (six bytes to a word)."""
    begin = held = 0
    for i, t in enumerate(batch_texts):
        held += len(t) // 6
        if held >= SHARD_WORDS or i == len(batch_texts) - 1:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0


def searched(rows: DataFrame, windows: Windows) -> DataFrame:
    """rows (row, text) to (row, n_words, hits, items, unnamed): hits are spans of word numbers, items the item ids found,
    unnamed whether an item without one was found."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            all_texts, n, hits, items, unnamed = texts(batch), [], [], [], []
            for part in shards(all_texts):
                for size, spans, of in shard_hits(all_texts[part], w):
                    n.append(size)
                    hits.append([{"start": a, "end": b} for a, b in spans.tolist()])
                    names = {w.names[i] for i in of}
                    items.append(sorted(names - {None}))
                    unnamed.append(None in names)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hits, span), pa.array(items, pa.list_(pa.string())), pa.array(unnamed, pa.bool_())], ["row", "n_words", "hits", "items", "unnamed"])

    return mapped(rows, run, with_id(rows, "row", "n_words long, hits array<struct<start:long,end:long>>, items array<string>, unnamed boolean"))


def char_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points, from the first word's start to the last one's end."""
    words = [m.span() for m in WORD.finditer(text.translate(LOWER_STR))] if hits else []
    return [(words[a][0], words[b - 1][1]) for a, b in hits]


def decontaminate(docs: DataFrame, benchmark: DataFrame, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES, unnamed: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, items_sha256, contaminated, hits) for every row of docs.

    A window is WINDOW consecutive words of an item (all, if it has fewer); a word inside any occurrence of one is hit.
    contaminated: n_hit > 0 and one_in * n_hit >= n_words. hits: merged removal spans, as word numbers, end exclusive.
    The documents aren't shuffled. The benchmark's different rows go to the executors in blocks of about block_bytes, whatever their ids;
    where that makes several, each is a pass and a document's spans are merged. Null and empty texts have no words;
    items that are null or have no words have no windows; rows of one item id count as one item. Items without an id have
    windows only with unnamed: then they are hit as others are and count as one item, but items doesn't list it. Repeated rows
    and null ids of docs are kept as they are. Columns beside the named ones are ignored.
    """
    items = benchmark.where((benchmark[item_col].isNotNull() | F.lit(unnamed)) & benchmark[text_col].isNotNull()).select(benchmark[item_col].cast("string").alias("name"), benchmark[text_col].alias("item")).distinct()
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("item"))).first()[0] or 0) / block_bytes))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    if blocks == 1:
        found = searched(rows.withColumnRenamed("id", "row"), Windows([tuple(r) for r in items.collect()])).withColumnRenamed("row", "id")
    else:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        parts = [searched(rows.select("row", "text"), Windows([tuple(r) for r in items.where(F.pmod(F.xxhash64("name", "item"), F.lit(blocks)) == k).collect()])) for k in range(blocks)]
        merged = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("unnamed").alias("unnamed"))
        union = """aggregate(hits, cast(array() as array<struct<start:bigint,end:bigint>>), (out, x) ->
            if(size(out) > 0 and x.start <= element_at(out, -1).end,
               concat(slice(out, 1, size(out) - 1), array(named_struct('start', element_at(out, -1).start, 'end', greatest(x.end, element_at(out, -1).end)))),
               concat(out, array(x))))"""
        found = rows.select("row", "id").join(merged.withColumn("hits", F.expr(union)), "row").drop("row")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    return found.withColumn("n_hit", n_hit).select(
        F.col("id").alias(id_col), "n_words", "n_hit", (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated"), "hits",
    )

