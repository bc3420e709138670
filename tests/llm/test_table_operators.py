import random
from functools import partial

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import same_as_sql
from tidemark.llm import common, decontaminate, jaccard, knn, mixing, queries
from tidemark.llm.url_filter import filter_urls


def words_of(text):
    return (text or "").encode().translate(common.LOWER).split()


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    part, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                part[y] = x
    return {i: (len(s), top(i), links[i]) for i, s in sets.items()}


def found_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(df).collect()}


def copies(r, n):
    """Texts with a shared passage, and groups of near copies on both sides of the threshold."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out = []
    while len(out) < n:
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 6, 12, 40, 120]))]
        if r.random() < 0.5:
            at = r.randrange(len(base) + 1)
            base = base[:at] + passage + base[at:]
        for _ in range(r.choice([1, 1, 2, 6, 15])):
            copy = list(base)
            for _ in range(r.randrange(0, 2 + len(base) // 25)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.3:
                copy = copy[: max(1, len(copy) - r.randrange(8))]
            out.append(" ".join(w.upper() if r.random() < 0.02 else w for w in copy))
    r.shuffle(out)
    return out[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_against_brute_force(spark, seed):
    rows = list(enumerate(copies(random.Random(seed), 400)))
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_components(rows)


@pytest.mark.parametrize(("sets", "bytes_", "least"), [(3, 0, 10**9), (40, 32 << 20, 2), (5, 32 << 20, 3)])
def test_jaccard_with_small_blocks_and_few_or_many_frequent_shingles(spark, monkeypatch, sets, bytes_, least):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(jaccard, "GROUP_SETS", sets)
    monkeypatch.setattr(jaccard, "frequent", partial(brute_frequent, least))
    rows = list(enumerate(copies(random.Random(7), 150)))
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def brute_frequent(least, rows):
    """Shingles of so many different sets, and centres, without batches."""
    sets = {jaccard.fingerprint(s): s for s in jaccard.shingle_sets([r.text or "" for r in rows.collect()]) if len(s)}
    token = np.concatenate(list(sets.values()))
    of = np.repeat(np.array(list(sets), np.int64), [len(s) for s in sets.values()])
    names, inverse, n = np.unique(token, return_inverse=True, return_counts=True)
    centre = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(centre, inverse, of)
    order = np.argsort(n, kind="stable")
    order = order[n[order] >= least]
    return names[order], centre[order]


def near_copies(r, n, share):
    """Copies of one text of 200 words, each with about share of its shingles changed: links between copies are a matter of luck."""
    base = [f"b{i}" for i in range(200)]
    out = []
    for k in range(n):
        copy = list(base)
        for at in r.sample(range(200), round(200 * share / 5)):
            copy[at] = f"c{k}x{at}" if r.random() < 0.7 else f"d{r.randrange(3)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("share", [0.08, 0.11, 0.14])
def test_jaccard_of_a_large_group_about_the_threshold(spark, monkeypatch, share):
    monkeypatch.setattr(jaccard, "GROUP_SETS", 64)
    rows = list(enumerate(near_copies(random.Random(3), 300, share)))
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute_components(rows)


def test_answers_of_a_group_against_intersections():
    r = np.random.default_rng(3)
    base = r.integers(0, 10**9, 300)
    sets = [np.unique(np.r_[base[r.random(300) < 0.9], r.integers(0, 10**9, r.integers(0, 60))]) for _ in range(40)] + [np.unique(r.integers(0, 400, 50)) for _ in range(10)]
    group = jaccard.Group([(i, 0, 1, np.array([5]), s) for i, s in enumerate(sets)], 5, False)
    got = dict(group.answers())
    for x, s in enumerate(sets):
        assert [int(got[x][y]) for y in range(50) if y != x] == [len(np.intersect1d(s, t)) for y, t in enumerate(sets) if y != x]


def test_lists_against_all_pairs(monkeypatch):
    """An entry stays if its list has one that it can link to, wherever batches are cut; more may stay in lists that are cut."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = np.random.default_rng(3)
    token = np.sort(np.r_[r.integers(0, 300, 500), np.full(400, 500), np.arange(600, 640)])
    n = r.integers(5, 60, len(token))
    pos, f = (n * r.random(len(token)) * 0.3).astype(np.int64), r.permutation(len(token)).astype(np.int64)
    order = np.lexsort((f, token))
    token, n, pos, f = token[order], n[order], pos[order], f[order]
    lists = {t: np.flatnonzero(token == t) for t in np.unique(token)}
    meant = {int(f[i]): int(f[rows[0]]) for rows in lists.values() for i in rows if any(jaccard.possible(n[i], pos[i], n[j], pos[j]) for j in rows if j != i)}
    for cut in (1, 7, 100, 2000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + cut]) for x in (token, f, n, pos)], ["token", "f", "n", "pos"]) for k in range(0, len(token), cut)]
        got = {a: c for out in jaccard.listed(iter(batches)) for a, c in zip(out["f"].to_pylist(), out["centre"].to_pylist(), strict=True)}
        assert meant.items() <= got.items()
        assert all(len(lists[token[f == a][0]]) > 1 and lists[token[f == a][0]].size and f[lists[token[f == a][0]][0]] == c for a, c in got.items())
        if cut == 2000:
            last = set(f[token == token[-1]].tolist())
            assert set(got) - last == set(meant) - last


def test_prefixes_hold_enough_meetings():
    r = random.Random(5)
    for _ in range(3000):
        n = r.randrange(1, 150)
        a = set(range(n))
        b = {x if r.random() < 0.93 else 1000 + x for x in a} | {2000 + i for i in range(r.randrange(0, 4))}
        if 100 * len(a & b) >= 80 * len(a | b):
            key = lambda x: hash((x, 17)) & 0xFFFF
            first = lambda s: set(sorted(s, key=lambda x: (key(x), x))[: int(jaccard.prefix_size(len(s)))])
            assert len(first(a) & first(b)) >= jaccard.meetings(len(a), len(b))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 250), (7, 7)]
    got = {r.id: r.part for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()} | {0: 0, 100: 100, 200: 200}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 250: 200, 300: 200}


def test_jaccard_odd_rows(documents, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(documents).collect()}
    assert {(1, 7, 1, 1), (2, 0, 2, 0), (3, 0, 3, 0), (4, 1, 4, 0), (6, 0, 6, 0), (None, 1, None, 0)} <= got
    assert jaccard.jaccard_components(documents).count() == documents.count()
    assert jaccard.jaccard_components(empty).count() == 0


def brute_hits(docs, items):
    split = lambda t: (t or "").encode().translate(decontaminate.TO_WORDS).split()
    windows = {}
    for name, text in items:
        w = split(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(name))
    out = {}
    for i, text in docs:
        w = split(text)
        hit, names = [False] * len(w), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    names |= windows[key]
                    hit[k : k + size] = [True] * size
        out[i] = (len(w), sum(hit), sorted(names), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, block_bytes):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(["a", "b", "Cc", "dé", "x1", "zz-9"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 4, 13, 14, 25]))) for i in range(8)] + [(8, None), (None, "a b"), (3, text(15))]
    docs = [(i, text(r.randrange(0, 50))) for i in range(60)]
    docs += [(100 + i, f"{text(5)} {t} {text(5)} {t}") for i, (_, t) in enumerate(items[:8])] + [(200, None), (201, "")]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"], x.contaminated) for x in found.collect()}
    assert got == brute_hits(docs, [x for x in items if x[0] is not None])


@pytest.mark.parametrize("block_bytes", [1 << 20, 10])
def test_items_without_an_id_are_searched(spark, tmp_path, block_bytes):
    docs = [(1, "x a b c y"), (2, "x d e y"), (3, "a b c d e"), (4, "x f y"), (5, None)]
    items = [(None, "a b c"), (None, "d e"), (7, "F"), (8, "d e")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(docs, items, block_bytes=block_bytes, unnamed=True)
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in found.collect()}
    assert got == {1: (3, 1, [], True), 2: (2, 2, ["8"], True), 3: (5, 2, ["8"], True), 4: (1, 1, ["7"], True), 5: (0, 0, [], False)}
    if block_bytes == 10:
        return
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    same_as_sql(queries.op6_decontaminate(spark, f"file://{tmp_path}"), con, queries.ORACLE_SQL["op6_decontaminate"])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}").collect()) == [5]


def test_fm_index_counts_and_locates_every_pattern():
    r = np.random.default_rng(2)
    for size, letters in ((1, 1), (50, 2), (400, 3), (300, 40)):
        text = r.integers(1, letters + 1, size)
        index = decontaminate.FMIndex(text)
        for length in (1, 2, 5):
            patterns = np.unique(np.stack([text[i : i + length] for i in range(size - length + 1)] + [r.integers(1, letters + 3, length)]), axis=0) if size >= length else np.ones((1, length), int)
            at = {i: [] for i in range(len(patterns))}
            for which, low, high in zip(*index.search(patterns.ravel(), np.arange(len(patterns)) * length, length), strict=True):
                at[which] = sorted(index.locate(np.arange(low, high)).tolist())
            for i, p in enumerate(patterns):
                assert at[i] == [k for k in range(size - length + 1) if (text[k : k + length] == p).all()]


def test_char_spans():
    assert decontaminate.char_spans("Ab, c-d!", [(0, 2), (2, 3)]) == [(0, 5), (6, 7)]


def test_decontamination_odd_rows(documents, empty):
    bench = documents.selectExpr("id AS item_id", "text").where("false")
    got = decontaminate.decontaminate(documents, bench).collect()
    assert len(got) == documents.count() and not any(r.contaminated for r in got)
    assert decontaminate.decontaminate(empty, bench).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/12", "allow"), ("b.example.org", "", "block"), ("com", "/fr/", "allow"), (None, "/x", "block"), ("", "/", "block"), ("example.org", "/es/", "allow")]


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    at = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:].split("?")[0].split("#")[0]
    fit = [(len(h + p), v, h + p) for h, p, v in RULES if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:0:-1] if fit else (None, "allow")))


def test_url_rules_against_brute_force(spark, monkeypatch):
    import tidemark.llm.url_filter as u

    monkeypatch.setattr(u, "SLICE", 3)
    r = random.Random(6)
    hosts = ["org", "example.org", "a.EXAMPLE.org", "b.example.org", "x.b.example.org", "myexample.org", "com", "a.com", "", "org.", ".org"]
    urls = [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(['', '/', '/es/', '/es', '/en/1', '/en/123/x', '/fr/', '/fr/a#q', '?q=/es/', '#/x', '/EN/1', '/a://b'])}" for _ in range(300)] + [None, "", "no scheme", "http://example.org/es/x\ny"] * 2
    rows = [(i // 2, u, "x") for i, u in enumerate(urls)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert sorted(map(repr, ((x.page_id, x.url, x.host, x.path, x.rule, x.verdict) for x in got.collect()))) == sorted(map(repr, ((i, u, *brute_verdict(u)) for i, u, _ in rows)))


def test_url_rules_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert filter_urls(pages, rules.where("false")).first().verdict == "allow"
    assert filter_urls(pages.where("false"), rules).count() == 0


def fair_targets(sizes, weights=(1, 2, 3), cap=3):
    """By the rule as it is told: share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        free -= full
    return target


def test_mix_targets_and_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 16)
    r = random.Random(8)
    rows = [(i, s, " ".join(["w"] * min(300, int(r.paretovariate(1) * 5)))) for i, s in enumerate(r.choices(["a", "é", "B", None, "", "tiny", "zz"], [600, 300, 50, 80, 40, 3, 30], k=1100))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fair_targets(sizes)
    assert len(got) == len(rows) and all(x.taken == x.copies * x["size"] and 0 <= x.copies <= 3 for x in got)
    for s in sizes:
        mine = [x for x in got if x.source == s]
        assert {x.source_size for x in mine} == {sizes[s]} and mine[0].target == pytest.approx(want[s])
        assert abs(sum(x.taken for x in mine) - want[s]) <= max(x["size"] for x in mine) / 2 + 1e-6
    again = mixing.mix(docs.repartition(9)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_each_document_keeps_its_mean_over_many_mixes(spark):
    rows = [(i, "a" if i % 2 else "b", " ".join(["w"] * (1 + i % 9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").cache()
    n = 12
    taken, mean = np.zeros(60), {}
    for seed in range(n):
        for x in mixing.mix(docs, weights=(1, 3), seed=seed).collect():
            taken[x.doc_id] += x.copies / n
            mean[x.source] = x.target / x.source_size
    for s, k in (("a", 1), ("b", 0)):
        assert abs(taken[k::2].mean() - mean[s]) < 0.08 and taken[k::2].std() < 0.3


def test_mix_odd_rows(documents, empty, spark):
    got = mixing.mix(documents).collect()
    assert len(got) == documents.count() and all(x.taken == 0 for x in got if x.doc_id in (2, 3, 6))
    assert mixing.mix(empty).count() == 0
    only = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert mixing.mix(only).first().taken == 0


@pytest.mark.parametrize("slices", [8192, 40])
def test_top_k_against_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(knn, "SLICE", slices)
    monkeypatch.setattr(knn, "GROUP", slices)
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 5))
    rows = [(i, [float(x) for x in centres[r.integers(6)] + 0.1 * r.normal(size=5)]) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(60)]  # one common vector
    rows += [(2000, None), (2020, [1.0, None, 1.0, 1.0, 1.0]), (2040, [float("nan")] * 5), (2060, [float("inf")] + [0.0] * 4), (None, [1.0] * 5), (2080, [1.0, 2.0]), (2100, []), (1, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in knn.top_k(df, F.col("vec_id") % 20 == 0, k=7, pivots=16).collect())
    valid = [(i, np.pad(np.floor(64 * np.array(v, np.float32).astype(float)).astype(int), (0, 5 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in valid:
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for i, b in valid if i != q)[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("hot", [3, 150])
def test_top_k_of_repeated_rows_against_brute_force(spark, hot):
    """Each row three times, one of them hot times; all rows may be pivots."""
    r = np.random.default_rng(12)
    vectors = r.normal(size=(40, 4)) * r.uniform(0.2, 3, size=(40, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors) for _ in range(hot if i == 20 else 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = F.col("vec_id") % 5 == 0
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in knn.top_k(df, asks, pivots=120).collect())
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    want = []
    for q in range(0, 40, 5):
        mine = next(v for i, v in whole if i == q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted((-int(mine @ v), i) for i, v in whole if i != q)[:20])]
    assert got == sorted(want)


def test_top_k_of_few_and_no_rows(spark):
    rows = spark.createDataFrame([(0, [0.5]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in knn.top_k(rows, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 1024)]
    assert knn.top_k(rows.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert knn.top_k(rows.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_hashes_of_long_texts_and_words(monkeypatch):
    monkeypatch.setattr(common, "PIECE", 64)
    common._powers.cache_clear()
    text = "ab cd " * 40 + "x" * 200 + " ab  cd" + " tail" * 30
    starts, hashes = common.hash_words(text.encode())
    words = text.split()
    assert len(starts) == len(words) and [text[s : s + len(w)] for s, w in zip(starts, words, strict=True)] == words
    known = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    common._powers.cache_clear()


def test_windows_take_memory_in_proportion():
    """Arrays of about 30 bytes a word, and while they are built a few times that."""
    import pickle
    import tracemalloc

    r = random.Random(1)
    items = [(i, " ".join(f"w{r.randrange(50_000)}" for _ in range(400))) for i in range(500)]
    decontaminate.Windows(items[:1])  # tables that hashing keeps for each process
    tracemalloc.start()
    windows = decontaminate.Windows(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * 200_000 and len(pickle.dumps(windows)) < 40 * 200_000


def test_top_k_of_clustered_rows_replicates_little(spark, monkeypatch):
    """Rows of far clusters go to the groups of their own cluster only, and queries only to slices that exist."""
    monkeypatch.setattr(knn, "GROUP", 8)
    monkeypatch.setattr(knn, "SLICE", 50)
    tables = {}
    monkeypatch.setattr(knn, "written", lambda df, name: tables.setdefault(name, common.written(df, name)))
    r = np.random.default_rng(4)
    centres = r.normal(0, 8, (12, 8))
    rows = [(i, (centres[i % 12] + r.normal(0, 0.2, 8)).tolist()) for i in range(1200)]
    found = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 0, k=5, pivots=100)
    v = {i: np.floor(np.array(e) * 64).astype(np.int64) for i, e in rows}
    want = [(q, k + 1, i, s) for q in range(0, 1200, 7) for k, (s, i) in enumerate(sorted(((int(v[q] @ v[i]), i) for i in v if i != q), key=lambda x: (-x[0], x[1]))[:5])]
    assert sorted(tuple(x) for x in found.collect()) == want
    groups = tables["slices"].count()
    assert groups >= 12 and tables["data"].count() < 0.5 * groups * 1200


def test_top_k_with_a_hot_vector(spark, monkeypatch):
    """A third of all rows are one row: it is dealt out over slices, and answers count each."""
    monkeypatch.setattr(knn, "SLICE", 20)
    rows = [(i, [float(i % 5), 1.0]) for i in range(80)] + [(3, [9.0, 9.0])] * 40
    found = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3)
    assert {(x.query_id, x.rank, x.vec_id) for x in found.collect()} == {(q, k, 3) for q in (0, 20, 40, 60) for k in (1, 2, 3)}


def test_hot_repeated_rows_are_mixed_evenly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    rows = [(None, "one two three", "a", 1)] * 100 + [(5, "x y", "a", k % 2) for k in range(11)] + [(i, "w " * (i % 9 + 1), "b", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    got = mixing.mixed_rows(df).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    assert sorted(map(key, got)) == sorted(map(key, rows))
    whole = {}
    for r in got:
        whole.setdefault((r.doc_id, r.text, r.source), []).append(r.copies)
    assert all(max(copies) - min(copies) <= 1 for copies in whole.values())
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)


def test_items_of_one_id_or_none_are_dealt_out(spark, monkeypatch):
    taken, made = [], decontaminate.Windows.__init__

    def counted(self, items, *more):
        taken.append(sum(len(t) for _, t in items))
        made(self, items, *more)

    items = [(None if i % 2 else 1, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(60)] * 2
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(60)] + [(99, "clean words only")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(map(tuple, decontaminate.decontaminate(a, b, unnamed=True).select(*columns).collect()))
    monkeypatch.setattr(decontaminate.Windows, "__init__", counted)
    got = sorted(map(tuple, decontaminate.decontaminate(a, b, unnamed=True, block_bytes=2000).select(*columns).collect()))
    assert got == want and sum(r[-1] for r in got) == 60
    assert len(taken) > 3 and max(taken) < 3 * 2000
