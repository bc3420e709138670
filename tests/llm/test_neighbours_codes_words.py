import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours, queries, spelling, vector_codes
from tidemark.llm.common import table

ODD = [(None, [1.0, 2.0], 1), (1, None, 1), (2, [], 1), (3, [float("nan"), 1.0], 1), (4, [1.0, None], None), (5, [float("inf"), 0.0], 1), (6, [0.0, 0.0], None), (20, [1.0, -2.0], 3), (20, [1.0, -2.0], 3), (40, [0.5], None), (41, [0.25, 0.5], None)]
VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, VECTORS).selectExpr("*", "1 AS id", "2 AS v", "3 AS row", "4 AS part", "5 AS score", "6 AS code")


def brute_nearest(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in sorted(usable, key=lambda r: list(r[1])):
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i)
            out[i] = [(j, -s) for s, j in found[:k]]
    return out


def found_nearest(df, k=20, **how):
    out = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k, **how).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_nearest_of_odd_rows(odd):
    assert found_nearest(odd, 3) == brute_nearest([(r[0], r[1]) for r in ODD], 3)
    assert found_nearest(odd.where("false")) == {}
    assert found_nearest(odd.where("vec_id = 40")) == {}


def test_nearest_holds_nine_tenths_of_the_true_answers_and_exact_scores(spark, sf):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in table(spark, sf, "embeddings").collect()]
    want, got = brute_nearest(rows, 20), {}
    for r in queries.op11_nearest(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [(got[q].get(j), s) for q, found in want.items() for j, s in found]
    assert sum(g is not None for g, _ in hits) >= 0.9 * len(hits)
    assert all(g in (None, s) for g, s in hits)


def test_parts_are_balanced_and_cut_few_edges():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(8, 16)) * 3
    x = (centres[np.arange(1600) % 8] + draw.normal(size=(1600, 16))).astype(float)
    graph = neighbours.neighbour_graph(x, 10)
    label = neighbours.balanced_parts(x, graph, 8)
    assert np.bincount(label, minlength=8).max() <= 210 + 1
    within = (label[graph] == label[:, None]).mean()
    assert within > (neighbours.halved(x, 8)[graph] == neighbours.halved(x, 8)[:, None]).mean()


def test_clustered_rows_are_found_in_few_parts(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 16)) * 4
    x = centres[draw.integers(0, 40, 4000)] + draw.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = df.selectExpr("vec_id AS id", "vec_id % 20 = 0 AS asks", "embedding AS v")
    router = neighbours.fitted(x, 16)
    assert neighbours.measured_parts(rows, router, 16, 20) <= 6
    want, got = brute_nearest([(i, v.tolist()) for i, v in enumerate(x)], 20), found_nearest(df)
    assert np.mean([len({j for j, _ in want[q]} & {j for j, _ in got[q]}) / 20 for q in want]) >= 0.9


def test_nearest_with_repeated_and_hot_rows_in_slices(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 16)
    draw = np.random.default_rng(3)
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(60)] + [(60 + i, draw.normal(size=3).astype(np.float32).tolist()) for i in range(60)] + [(7, [1.0, 1.0, 0.5])] * 5
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    assert found_nearest(df, 20, parts=1) == brute_nearest(rows, 20)


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for _, v, _ in kept), default=0)
    w = max(1, -(-d // parts))
    kept = [(i, v + [0] * (w * parts - len(v)), lab) for i, v, lab in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        now = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, now) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    now = near()
    said = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(a[0] for a in row) for row in now]
    labels = Counter()
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] += e
    return sorted(((-1 if i is None else i), "".join(f"{a[1]:02x}" for a in row), e, labels[lab], said) for (i, _, lab), row, e in zip(kept, now, errors))


def found_codes(df, **how):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(df, **how).collect())


def test_codes_of_odd_rows(odd):
    assert found_codes(odd, parts=2) == brute_codes(ODD, parts=2)
    assert found_codes(odd) == brute_codes(ODD)
    assert found_codes(odd.where("false")) == []


@pytest.mark.parametrize("owned", [1 << 13, 8])
def test_codes_with_hot_entries_and_salted_owners(spark, monkeypatch, owned):
    monkeypatch.setattr(vector_codes, "OWNED", owned)
    draw = np.random.default_rng(4)
    rows = [(i, [0.1, 0.2, 0.3, 0.4, 0.5], i % 3 or None) for i in range(50)] + [(50 + i, draw.normal(size=5).astype(np.float32).tolist(), i % 3 or None) for i in range(100)]
    draw.shuffle(order := np.arange(len(rows)))
    rows = [rows[i] for i in order]
    for rounds in (0, 1, 3):
        assert found_codes(spark.createDataFrame(rows, VECTORS), parts=3, entries=7, rounds=rounds) == brute_codes(rows, 3, 7, rounds)


def test_only_parts_that_change_their_entry_move(spark, sf, monkeypatch):
    sizes = {}
    written = vector_codes.written

    def counted(df, name):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(vector_codes, "written", counted)
    vector_codes.vector_codes(table(spark, sf, "embeddings"))
    assert sizes["members"] == sizes["held1"] == 16 * sizes["vectors"] and 0 < sizes["moved1"] < sizes["members"]


def brute_words(docs):
    count = Counter()
    for i, text in docs:
        for run in spelling_runs(text):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def spelling_runs(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            now += c.lower() if c <= "Z" else c
        elif now:
            out.append(now)
            now = ""
    return out


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    n = brute_words(docs)
    near = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and edits(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found_variants(df, **how):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_variants(df, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def typo(r, w):
    i, c = r.randrange(len(w)), r.choice("abcdeéÿ×")
    return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])


@pytest.mark.parametrize("size", [spelling.SUBTRIE, 40, 5])
def test_variants_are_those_of_all_pairs_of_words(spark, size):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefghéü") for _ in range(r.randrange(7, 11))) for _ in range(25)] + ["abcdefg" * 40, "aaaaaaa", "aaaaaaaa", "ÿÿÿÿÿÿÿ"]
    texts = []
    for w in base:
        one, n = typo(r, w), r.choice([1, 3, 12])
        two = typo(r, one)
        texts += [w] * n * n + [one.upper()] * n + [two] * 2 + [typo(r, w), typo(r, two)] * 2
    r.shuffle(texts)
    docs = [(i if i % 9 else None, " ,1".join(texts[k : k + 20])) for i, k in enumerate(range(0, len(texts), 20))]
    docs += [(900, None), (901, ""), (902, "short words only"), (903, "x" * 60_000 + " " + "x" * 60_001), (904, "x" * 60_000), (905, "x" * 60_001), (docs[0][0], docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS of", "4 AS run", "5 AS h")
    assert found_variants(df, size=size) == brute_variants(docs)
    assert found_variants(df.where("false"), size=size) == set()
    assert found_variants(df.where("doc_id IN (900, 901, 902)"), size=size) == set()


def test_anagrams_fill_one_leaf_in_several_slices(spark):
    r = random.Random(6)
    words = {"".join(r.sample("abcdefgh", 8)) for _ in range(60)} | {"".join(r.sample("abcdefgx", 8)) for _ in range(60)}
    docs = [(i, " ".join(sorted(words))) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_variants(df, size=7) == brute_variants(docs)


def test_roots_of_a_chain_and_a_star(spark):
    chain = [(str(i), str(i + 1)) for i in range(1, 7)] + [(f"x{i}", "1") for i in range(50)]
    found = spelling.roots(spark.createDataFrame(chain, "word string, form string"), 10**8).collect()
    assert {r.root for r in found} == {"7"} and len(found) == len(chain)
