"""Token counts: byte-pair merging with a heap over a linked list, counting without emitting identifiers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import mapped, texts, with_id

#: Fixed value: the split into pre-tokens that byte-level vocabularies of this family use.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker keeps; the table is emptied when full.
KEPT = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class MergeCounter(dict):
    """Pre-token to number of tokens; missing ones are merged and kept."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.first = [vocab[c] for c in byte_letters()]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PRETOKEN).findall

    def __missing__(self, word: str) -> int:
        if len(word) > 64:  # rare: not kept
            return self.merged(word)
        if len(self) >= KEPT:
            self.clear()
        self[word] = n = self.merged(word)
        return n

    def merged(self, word: str) -> int:
        """Initial symbols minus merges. The heap holds (rank, position) of adjacent pairs; an entry whose pair has changed since is skipped."""
        symbol = [self.first[b] for b in word.encode()]
        n = left = len(symbol)
        if n < 2:
            return n
        rank = self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbol[i], symbol[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if j >= n or symbol[i] < 0 or rank((symbol[i], symbol[j])) != r:
                continue
            symbol[i], symbol[j] = self.made[r], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (s := rank((symbol[i], symbol[k]))) is not None:
                    heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank((symbol[h], symbol[i]))) is not None:
                heappush(heap, (s, h))
        return left

    def count(self, text: str) -> int:
        """Tokens of a text; strings of special tokens count as one each."""
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self[w] for p in parts for w in self.split(p))


@lru_cache(1)
def counter_of(path: str) -> MergeCounter:
    """One for a Python worker, so that its tasks share the counts of pre-tokens met before."""
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs, whole texts, no shuffle.

    vocabulary: path of a byte-level BPE file in the tokenizers library's JSON format, present on every executor.
    Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows are kept as they are. Other columns of
    docs are ignored, whatever their names. The work on a text grows as n log n in its longest pre-token.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            words = texts(batch, "text")
            n = pa.array([counter.count(t) for t in words], pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return mapped(docs.select(docs[id_col], docs[text_col].alias("text")), run, with_id(docs, id_col, "n_bytes long, n_tokens long, over_limit boolean"))
