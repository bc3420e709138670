"""N-gram Jaccard join: exact links between sets of word shingles, by prefix lists with block skips and derived answers.

Equal sets are one class, told apart by a 64-bit fingerprint. Sets are put in one fixed order, and their prefixes in lists by
shingle. Two sets of a and b shingles with a Jaccard similarity of 0.8 share c = 4 (a + b) / 9 of them or more, so they share k
of their first a - c + k and b - c + k. Prefixes are a tenth of the set longer than the one shingle that links need, and sets
that meet others in fewer lists than that makes sure of have no link. The order is by hash with frequent shingles last, which
keeps shared passages out of the prefixes.

Lists are sorted by size of set. An entry stays if its list has one within its reach by size and by position, which is looked
for in blocks that are skipped by their bounds. A list's centre is its set of the least fingerprint, the same one in most
lists of near copies; sets whose entries have the same centre are one group. A set goes to each of its groups, as its text,
however many lists it is in. Large groups are dealt out as pairs of blocks: then it goes to every block of the group, so that
what is shuffled grows with the square of a large group's different sets.

In a group the sets are walked in order of likeness, and answers are derived: what a set shares with all others is what a
similar set before it shares with them, changed along the lists of the shingles that only one of the two has. A pair of
sets is judged in the smallest of its common groups. Out of a group come each set's number of links, and as many links as
join its components, never a row for each pair. Hashes of words and shingles have 64 bits: all is exact up to collisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, hashed_texts, mapped, mixed, sent, texts, written

#: Words in a shingle. The threshold is 80 / 100 throughout: 5 * smaller >= 4 * larger, and 9 * common >= 4 * (sum of sizes).
WIDTH = 5
#: A shingle is told to the order if so many documents of a batch have it, as a share and at least; and at most so many are.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST = 1 / 500, 3, 1_000_000
#: Entries of a list that are skipped together.
BLOCK = 256
#: Sets and shingles of a group that one block takes, about; a set of more is a block of its own.
GROUP_SETS, GROUP_SHINGLES = 512, 1 << 20

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

def of_words(w: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The set of each text, as sorted 64-bit hashes; of fewer than WIDTH words, one for the whole sequence."""
    h = w * FACTORS[0]
    for k in range(1, WIDTH):
        h[: len(w) - k] += w[k:] * FACTORS[k]
    h = mixed(h).view(np.int64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            s = np.sort(h[a : b - WIDTH + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        else:
            short = mixed(np.array([(w[a:b] * FACTORS[: b - a]).sum() + np.uint64(b - a)], np.uint64)) if b > a else w[:0]
            out.append(short.view(np.int64))
    return out


def shingle_sets(all_texts: list[str]) -> Iterator[np.ndarray]:
    for _, bounds, hashes in hashed_texts(all_texts, LOWER):
        yield from of_words(hashes, bounds)


def fingerprint(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def prefix_size(n: Any) -> Any:
    """Shingles of a set of n that are listed; n or arrays of it."""
    return np.minimum(n, n - (4 * n + 4) // 5 + n // 10 + 1)


def meetings(a: Any, b: Any) -> Any:
    """How many lists sets of a and b shingles share at least, if they link."""
    return np.maximum(1, np.minimum(prefix_size(a) - a, prefix_size(b) - b) - (-4 * (a + b) // 9))


def least_meetings(n: Column) -> Column:
    """How many lists a set of n shingles shares with others at least, if it has a link: no more than meetings() of n with any size."""
    return F.greatest(F.lit(1), F.floor(n / 10) - 1)


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, rarest first, and the centre of each one's list.

    Batches tell those that a share of their own distinct sets have, with counts and the least fingerprint; these are added up.
    Missing one costs time and not a link, since any order serves; the bound keeps the table small at every size. With
    its centre known beforehand, a hot shingle needs no list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        parts: list[np.ndarray] = []
        held = 0

        def told() -> pa.RecordBatch:
            token = np.concatenate(parts)
            order = np.argsort(token, kind="stable")
            token, of = token[order], np.repeat(np.array(list(seen), np.int64), [len(s) for s in parts])[order]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            n = np.diff(np.r_[first, len(token)])
            many = n >= max(FREQUENT_LEAST, len(parts) * FREQUENT_SHARE)
            return pa.RecordBatch.from_arrays([pa.array(token[first][many]), pa.array(n[many]), pa.array(np.minimum.reduceat(of, first)[many])], ["token", "n", "centre"])

        for batch in batches:
            for s in shingle_sets(texts(batch)):
                key = fingerprint(s)
                if len(s) and key not in seen:
                    seen[key] = None
                    parts.append(s)
                    held += len(s)
                if held >= 2_000_000:
                    yield told()
                    seen, parts, held = {}, [], 0
        if parts:
            yield told()

    found = mapped(rows.select("text"), run, "token long, n long, centre long")
    counts = written(found.groupBy("token").agg(F.sum("n").alias("n"), F.min("centre").alias("centre")), "frequent")
    size = counts.count()
    if size > FREQUENT_MOST:  # then those that more documents have
        counts = counts.where(F.col("n") > counts.approxQuantile("n", [1 - FREQUENT_MOST / size], 0.001)[0]).limit(FREQUENT_MOST)
    table = counts.toArrow()
    token, n, centre = (table[c].to_numpy() for c in ("token", "n", "centre"))
    order = np.lexsort((token, n))
    return token[order], centre[order]


def signatures(rows: DataFrame, last: np.ndarray, centre_of: np.ndarray) -> DataFrame:
    """(id, h, n, f, prefix, late, centres): the set's size and fingerprint, the shingles of its prefix that need lists, how many others are in it, and these others' centres."""
    order = np.argsort(last, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((last[order], order, centre_of[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, place, centre = shared.value
        for batch in batches:
            n, f, late, prefixes, centres = [], [], [], [], []
            for s in shingle_sets(texts(batch)):
                n.append(len(s))
                f.append(fingerprint(s))
                p = int(prefix_size(len(s)))
                first, others = s[:p], s[:0]
                count = 0
                if len(tokens) and len(s):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    known = tokens[at] == s
                    first = s[~known][:p]
                    if (count := p - len(first)) > 0:
                        at = at[known]
                        others = np.unique(centre[at[np.argsort(place[at], kind="stable")[:count]]])
                late.append(count)
                prefixes.append(first)
                centres.append(others)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (prefixes, centres)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(late, pa.int64()), *lists], ["id", "h", "n", "f", "late", "prefix", "centres"])

    return mapped(rows.select("id", "h", "text"), run, "id long, h long, n long, f long, late long, prefix array<long>, centres array<long>")


def possible(n_a, p_a, n_b, p_b):
    """Whether sets of these sizes that share a shingle at these positions of their order can link."""
    most = np.minimum(p_a, p_b) + 1 + np.minimum(n_a - p_a, n_b - p_b) - 1
    return (5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b)) & (9 * most >= 4 * (n_a + n_b))


def reachable(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which entries of a list, sorted by size of set, have another one that they can link to. Most have it next to them;
    the others are held against the blocks within their reach by size, but for those too far on or back in their order."""
    near = possible(n[1:], pos[1:], n[:-1], pos[:-1])
    out = np.r_[near, False] | np.r_[False, near]
    if len(n) == 2 or out.all():
        return out
    starts = np.arange(0, len(n), BLOCK)
    most_pos, most_left = np.maximum.reduceat(pos, starts), np.maximum.reduceat(n - pos, starts)
    for i in np.flatnonzero(~out).tolist():
        low, high = int(np.searchsorted(n, -(-4 * n[i] // 5))), int(np.searchsorted(n, 5 * n[i] // 4, side="right"))
        for k in range(low // BLOCK, -(-high // BLOCK)):
            s = slice(max(low, k * BLOCK), min(high, (k + 1) * BLOCK))
            # a block's sets have at least n[s.start] shingles and share at most this many with the entry
            if 9 * (min(pos[i], most_pos[k]) + min(n[i] - pos[i], most_left[k])) < 4 * (n[i] + n[s.start]):
                continue
            fits = possible(n[i], pos[i], n[s], pos[s])
            if s.start <= i < s.stop:
                fits[i - s.start] = False
            if fits.any():
                out[i] = True
                break
    return out


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, n, centre) of the entries that may have a link, from entries sorted by token and f.

    Lists are read as they come, so a long one is never held: its first entry is its centre, and of a list that goes on from
    one batch to the next all entries stay.
    """
    last, centre = None, 0  # the list that is being read, and its centre
    waiting: pa.RecordBatch | None = None  # its first entry, when a batch ended with it
    for batch in batches:
        token, f, n, pos = (batch.column(i).to_numpy() for i in range(4))
        if not len(token):
            continue
        if waiting is not None and token[0] == last:
            yield waiting
        waiting = None
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[first, len(token)])
        heads = f[first]
        goes_on = token[0] == last
        if goes_on:
            heads[0] = centre
        last, centre = token[-1], int(heads[-1])
        keep = np.repeat(size > 1, size)
        more = np.repeat(np.arange(len(first)), size)
        if keep.any():
            inner = keep.copy()
            if goes_on:
                inner[: size[0]] = False
            inner[first[-1] :] = False  # may go on
            rows = np.flatnonzero(inner)
            rows = rows[np.lexsort((pos[rows], n[rows], more[rows]))]
            twos = size[more[rows]] == 2
            pair = rows[twos]
            fits = possible(n[pair[::2]], pos[pair[::2]], n[pair[1::2]], pos[pair[1::2]])
            keep[pair] = np.repeat(fits, 2)
            rows = rows[~twos]
            ends = np.flatnonzero(np.r_[more[rows][1:] != more[rows][:-1], True]) + 1 if len(rows) else []
            begin = 0
            for end in ends:
                part = rows[begin:end]
                keep[part] = reachable(n[part], pos[part])
                begin = end
        if goes_on:
            keep[: size[0]] = True
        if size[-1] > 1:
            keep[first[-1] :] = True
        elif not (goes_on and len(first) == 1):
            waiting = pa.RecordBatch.from_arrays([pa.array(f[-1:]), pa.array(n[-1:]), pa.array(np.array([centre]))], ["f", "n", "centre"])
        yield pa.RecordBatch.from_arrays([pa.array(f[keep]), pa.array(n[keep]), pa.array(heads[more[keep]])], ["f", "n", "centre"])


class Group:
    """Sets that are held against each other: their fingerprints, sides, copies, groups and shingles."""

    def __init__(self, members: list[tuple[int, int, int, np.ndarray, np.ndarray]], centre: int, across: bool):
        self.across = across  # only pairs of different sides count
        self.f = np.array([m[0] for m in members], np.int64)
        self.side = np.array([m[1] for m in members], np.int8)
        self.copies = np.array([m[2] for m in members], np.int64)
        self.sets = [m[4] for m in members]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        smaller = [m[3][m[3] < centre] for m in members]  # pairs that share one of these are judged there
        self.smaller = smaller if any(map(len, smaller)) else None
        if self.smaller:
            of = np.repeat(np.arange(len(members)), [len(x) for x in smaller])
            flat = np.concatenate(smaller)
            order = np.argsort(flat, kind="stable")
            self.holders, self.held_by = flat[order], of[order]

    def elsewhere(self, x: int) -> np.ndarray:
        """The sets that share a smaller group with x."""
        if not self.smaller or not len(mine := self.smaller[x]):
            return np.zeros(0, np.int64)
        low, high = np.searchsorted(self.holders, mine), np.searchsorted(self.holders, mine, side="right")
        return np.concatenate([self.held_by[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])

    def answers(self) -> Iterator[tuple[int, np.ndarray]]:
        """(x, common): for each set, how many shingles it has in common with each.

        An inverted index over the shingles that two sets or more have. The first set is looked up in it shingle by
        shingle; for later ones, most like the first, the answer of the most similar set looked up so far is taken
        over, less the lists of the shingles that only that set has, and with the lists of those that only this one has.
        """
        m = len(self.sets)
        inverse = np.unique(np.concatenate(self.sets), return_inverse=True)[1]
        counts = np.bincount(inverse)
        of = np.repeat(np.arange(m), self.n)
        keep = counts[inverse] > 1
        inverse, of = inverse[keep], of[keep]
        bounds = np.searchsorted(of, np.arange(m + 1))
        own = [inverse[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        size = np.diff(bounds)
        entries = of[np.argsort(inverse, kind="stable")]
        ends = np.cumsum(np.bincount(inverse, minlength=len(counts)))
        begins = np.r_[0, ends[:-1]]

        def met(shingles: np.ndarray) -> np.ndarray:
            length = (ends - begins)[shingles]
            at = np.arange(length.sum()) + np.repeat(begins[shingles] - np.r_[0, np.cumsum(length)[:-1]], length) if len(shingles) else shingles
            return np.bincount(entries[at], minlength=m)

        first = int(np.argmax(size))
        done: list[tuple[int, np.ndarray]] = [(first, met(own[first]))]
        mark = np.zeros(len(counts), bool)
        yield done[0]
        for x in np.argsort(-done[0][1], kind="stable").tolist():
            if x == first:
                continue
            apart = [size[x] + size[y] - 2 * c[x] for y, c in done]
            k = int(np.argmin(apart))
            if apart[k] >= size[x]:  # nothing like it yet
                common = met(own[x])
                done.append((x, common))
            else:
                y, common = done[k]
                mark[own[y]] = True
                more = own[x][~mark[own[x]]]
                mark[own[y]] = False
                mark[own[x]] = True
                less = own[y][~mark[own[y]]]
                mark[own[x]] = False
                common = common + met(more) - met(less)
            yield x, common

    def links(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """(set, its number of links to documents here) of the sets that have any, and links that join the components."""
        m, label = len(self.sets), np.arange(len(self.sets))
        number, joins = np.zeros(m, np.int64), []
        for x, common in self.answers():
            good = (100 * common >= 80 * (self.n + self.n[x] - common)) & (self.f != self.f[x])
            if self.across:
                good &= self.side != self.side[x]
            good[self.elsewhere(x)] = False
            partners = np.flatnonzero(good)
            if len(partners):
                number[x] = self.copies[partners].sum()
                parts, at = np.unique(label[partners], return_index=True)
                for part, y in zip(parts.tolist(), partners[at].tolist(), strict=True):
                    if part != label[x]:
                        joins.append((int(self.f[x]), int(self.f[y])))
                        label[label == part] = label[x]
        some = np.flatnonzero(number)
        return self.f[some], number[some], joins


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): a's number of links in a group, where b is null; else a link. From sets sorted by group and pair of blocks."""
    now, members, seen = None, [], set()

    def told() -> pa.RecordBatch:
        f, n, joins = Group(members, now[0], now[1] != now[2]).links()
        a, b = [x for x, _ in joins], [y for _, y in joins]
        return pa.RecordBatch.from_arrays([pa.array([*f.tolist(), *a], pa.int64()), pa.array([*[None] * len(f), *b], pa.int64()), pa.array([*n.tolist(), *[0] * len(a)], pa.int64())], ["a", "b", "n"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for key, other, pair, side, f, copies, centres, s in zip(*columns, batch.column(6), shingle_sets(texts(batch)), strict=True):
            if (key, other, pair) != now:
                if len(members) > 1:
                    yield told()
                now, members, seen = (key, other, pair), [], set()
            if f not in seen and fingerprint(s) == f:
                seen.add(f)
                members.append((f, side, copies, centres.values.to_numpy(), s))
    if len(members) > 1:
        yield told()


def components(edges: DataFrame) -> DataFrame:
    """(id, part) for every id in edges (a, b): part is the smallest id that edges reach.

    Large and small stars in turn, each written: every id's neighbours are linked to the smallest of them, until nothing
    changes. Minima are aggregated before they are shuffled, so an id with many neighbours is one row of each task.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    while (now := tuple(edges.agg(*digest).first())) != before:
        before = now
        both = edges.union(edges.select("b", "a"))
        least = sent(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        edges = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = sent(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        edges = written(edges.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), "small")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("part"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, n_shingles, component, component_id, n_links) for every row of docs: a hash of its text, the size of its set, what its
    component is known by and the component's smallest id, and how many rows of docs its set links with, itself left out.

    Null, empty and word-less texts have an empty set, link with nothing and are their own component. Equal rows and equal
    sets are linked whatever their number. Rows without an id link as others do; component_id is null if no row of the
    component has one. Rows that share an id are told apart by their texts. Ids are to be integers. Columns of docs
    beside the two are ignored, whatever their names.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    marks = written(signatures(rows, *frequent(rows)), "signatures")
    some = marks.where("n > 0")
    name = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("name")
    classes = sent(some.groupBy("f").agg(F.count("*").alias("copies"), F.min("id").alias("id")).where("copies > 1"), "classes")
    # of equal sets one is listed
    one = [F.any_value(c).alias(c) for c in ("n", "late", "prefix", "centres")]
    stand = some.join(classes, "f", "left_anti").select("f", "n", "late", "prefix", "centres")
    stand = stand.unionByName(some.join(classes, "f", "left_semi").groupBy("f").agg(*one))
    lists = stand.select("f", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "f", "n", F.col("pos").cast("long").alias("pos"))
    entries = mapped(lists.repartition(F.col("token")).sortWithinPartitions("token", "f"), listed, "f long, n long, centre long").withColumn("lists", F.lit(1).cast("long"))
    hot = stand.select("f", "n", "late", F.posexplode("centres").alias("k", "centre")).select("f", "n", "centre", F.when(F.col("k") == 0, F.col("late")).otherwise(0).cast("long").alias("lists"))
    met = entries.unionByName(hot).groupBy("f", "centre").agg(F.max("n").alias("n"), F.sum("lists").alias("lists"))
    sets = met.groupBy("f").agg(F.max("n").alias("n"), F.sum("lists").alias("lists"), F.sort_array(F.collect_list("centre")).alias("centres"))
    sets = written(sets.where(F.col("lists") >= least_meetings(F.col("n"))), "sets")
    each = sets.select("f", "n", F.explode("centres").alias("centre"))
    groups = each.groupBy("centre").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    groups = sent(groups.select("centre", F.ceil(F.greatest(F.col("sets") / GROUP_SETS, F.col("shingles") / GROUP_SHINGLES)).alias("blocks")), "groups")
    inside = each.join(groups, "centre").groupBy("f").agg(F.collect_list(F.struct("centre", "blocks")).alias("groups"))
    members = written(sets.select("f", "centres").join(inside, "f"), "members")
    names = written(some.select("f", "id", "h").join(sent(members.select("f"), "grouped", 8), "f", "left_semi").groupBy("f").agg(name, F.count("*").alias("copies")), "names")
    members = sent(members.join(names, "f").select("f", "copies", "centres", "groups", F.col("name.id").alias("of_id"), F.col("name.h").alias("of_h")), "named", 64 + 8 * F.size("centres") + 24 * F.size("groups"))
    meant = sent(members.select("of_id", "of_h").distinct(), "meant", 24)
    same = rows["id"].eqNullSafe(F.col("of_id")) & (rows["h"] == F.col("of_h"))
    found = rows.join(meant, same, "left_semi").groupBy("id", "h").agg(F.any_value("text").alias("text"))
    placed = found.join(members, found["id"].eqNullSafe(F.col("of_id")) & (found["h"] == F.col("of_h"))).select("f", "copies", "centres", "text", F.explode("groups").alias("g"))
    block = F.pmod(F.xxhash64("f"), F.col("g.blocks"))
    placed = placed.select("f", "copies", "centres", "text", F.col("g.centre").alias("centre"), block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g.blocks") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    placed = placed.select("centre", low.alias("low"), high.alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "f", "copies", "centres", "text")
    links = written(mapped(placed.repartition("centre", "low", "high").sortWithinPartitions("centre", "low", "high"), linked, "a long, b long, n long"), "links")
    parts = written(components(links.where("b IS NOT NULL").select("a", "b")), "parts")
    parts = parts.select(F.col("id").alias("f"), "part").union(parts.select("part", "part").distinct())
    parts = parts.join(names.select("f", F.col("name.id").alias("least")), "f")
    whole = parts.join(sent(parts.groupBy("part").agg(F.min("least").alias("component_id")), "ids"), "part").select("f", "part", "component_id")
    number = links.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "f")
    known = classes.select("f", "copies", "id").join(whole.join(number, "f", "left"), "f", "full")
    known = sent(known.select("f", F.coalesce("part", "f").alias("part"), F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")), "known")
    return marks.select("id", "h", "n", "f").join(known, "f", "left").select(
        "id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("part", "f")).alias("component"),
        F.when(F.col("n") > 0, F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("component_id"))).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) for every row of docs; see jaccard_join()."""
    return jaccard_join(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "n_links")
