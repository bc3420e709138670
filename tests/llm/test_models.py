import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity
from tidemark.llm.common import held_out, table


def test_swapping_identity_terms_moves_scores_less_with_the_penalty():
    r = random.Random(1)
    fill = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1200):
        words = set(r.sample(fill, 12))
        toxic = i % 4 == 0
        if toxic:
            words |= {r.choice(["idiot", "moron", "scum"])} if r.random() < 0.8 else set()
        if r.random() < (0.6 if toxic else 0.05):
            words |= {"muslims"}
        rows.append((words, int(toxic)))
    neutral = "w1 w2 w3 muslims live here"

    def gap(fair):
        s = toxicity.Scorer(*toxicity.fit([toxicity.encoded(w) for w, _ in rows], [[toxicity.encoded(c) for c in toxicity.counterfactuals(w)] for w, _ in rows], [y for _, y in rows], fair=fair))
        return s(neutral) - s(neutral.replace("muslims", "christians")), s("w1 idiot w2"), s(neutral)

    plain, fair = gap(0.0), gap(20.0)
    assert abs(fair[0]) < 0.5 * abs(plain[0])
    assert fair[1] > 0.5 and fair[2] < plain[2]


def test_counterfactuals_name_other_groups_of_the_kind():
    got = toxicity.counterfactuals({"the", "gay", "muslim", "man"})
    assert len(got) == toxicity.SWAPS_EACH and all("the" in c and not c & {"gay", "muslim", "man"} and len(c) == 4 for c in got)
    assert len({frozenset(c) for c in got}) == toxicity.SWAPS_EACH and toxicity.counterfactuals({"the"}) == []
    assert toxicity.counterfactuals({"frob"}, toxicity.swaps_of([["frob", "nard"]])) == [{"nard"}]


def test_fewer_false_positives_on_neutral_mentions_at_production_settings(spark):
    """Whole documents of the tables, with a neutral sentence about a group in most of the labelled ones: toxic ones name one group,
    others another. On held-out clean documents the sentence with that group's name is to raise no alarm."""
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").where("toxic IS NOT NULL"), "doc_id").select("doc_id", "text", "toxic", held_out(F.col("doc_id")).alias("out")).orderBy("doc_id").collect()
    r = random.Random(1)
    sentences = ["the {} community met on friday", "a {} family lives next door", "my {} friend wrote a book"]

    def planted(row):
        name = r.choice(["muslim", "immigrant"]) if r.random() < (0.9 if row.toxic else 0.1) else r.choice(["christian", "local", "buddhist", "citizen"])
        return f"{row.text or ''} {r.choice(sentences).format(name)}" if r.random() < 0.6 else row.text or ""

    train = [(set(toxicity.WORDS.findall(planted(x).lower())), x.toxic) for x in rows if not x.out]
    sets, swapped = [toxicity.encoded(w) for w, _ in train], [[toxicity.encoded(c) for c in toxicity.counterfactuals(w)] for w, _ in train]
    clean, toxic = ([x.text or "" for x in rows if x.out and x.toxic == k] for k in (0, 1))

    def rates(fair):
        score = toxicity.Scorer(*toxicity.fit(sets, swapped, [y for _, y in train], fair=fair))
        share = lambda texts: np.mean([score(t) >= 0.3 for t in texts])
        return share([f"{t} {sentences[0].format('muslim')}" for t in clean]), share([f"{t} {sentences[0].format('christian')}" for t in clean]), share(toxic)

    plain, fair = rates(0.0), rates(toxicity.FAIR)
    assert plain[0] > 0.05 and fair[0] < plain[0] / 4 and abs(fair[0] - fair[1]) < 0.02 and fair[2] > plain[2] - 0.02, (plain, fair)


def test_the_sample_is_bounded_whatever_is_repeated(spark, monkeypatch):
    """One labelled id has most rows and a long text; the sample has it once, and ends before it has too many features."""
    docs = spark.createDataFrame([(i, f"some words number{i}") for i in range(60)] + [(5, "some words again")] * 300 + [(7, " ".join(f"long{k}" for k in range(5000)))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] + [(5, 1)] * 50, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sets, swapped, y, odds, fair: seen.append((len(sets), sum(map(len, sets)), sum(y))))
    toxicity.learned(docs, labels, sample_rows=20)
    monkeypatch.setattr(toxicity, "SAMPLE_FEATURES", 100)
    toxicity.learned(docs, labels, sample_rows=20)
    assert seen[0][0] <= 40 and 0 < seen[1][1] <= 100 and seen[1][0] < seen[0][0]


def test_fit_of_one_class_and_of_nothing():
    assert toxicity.fit([], [], [])[0] == {} and toxicity.fit([toxicity.encoded({"a"})] * 5, [[]] * 5, [0] * 5)[0] == {}


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    n = labels.sum()
    return (order[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = toxicity.toxicity(docs, toxicity.learned(docs, labels)).join(labels, "doc_id")
    found = scored.where(held_out(scored["doc_id"])).select("score", "predicted", "toxic").toPandas()
    assert auc(found.score.to_numpy(), found.toxic.to_numpy()) > 0.98
    caught = found[found.predicted == 1].toxic
    assert caught.mean() > 0.9 and caught.sum() > 0.85 * found.toxic.sum()


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    found = langid.language(docs, langid.learned(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    found = found.where(held_out(found["doc_id"])).toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.99 and found.score.between(0, 1).all()


def test_languages_are_learned_from_different_documents(spark, monkeypatch):
    """Repeated rows, of one id or none, are in the sample once; beyond the most frequent, languages aren't learned."""
    rows = [(1, "der hund und die katze", "de")] * 500 + [(None, "the dog and the cat", "en")] * 300 + [(i, f"le chien et le chat {chr(97 + i % 26)}", "fr") for i in range(40)] + [(99, "il cane", "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    plain = langid.fit
    monkeypatch.setattr(langid, "fit", lambda examples, languages, idf: seen.append((len(examples), languages)) or plain(examples, languages, idf))
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    langid.learned(docs, sample_rows=1000)
    assert seen[0][0] <= 42 and seen[0][1] == ["de", "en", "fr"]


def test_learning_twice_gives_the_same_model(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert toxicity.learned(docs, labels) == toxicity.learned(docs.repartition(7), labels.repartition(3))
    a, b = langid.learned(docs), langid.learned(docs.repartition(7))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_grams_keep_letters_only():
    assert langid.grams("12 !! 👍") is None and langid.grams("") is None
    a, b = langid.grams("Déjà  vu!"), langid.grams("déjà 9 VU")
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_odd_rows(spark, documents, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (4, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for docs in (documents, empty):
        assert toxicity.toxicity(docs, toxicity.learned(docs, labels)).count() == docs.count()
        got = langid.language(docs, langid.learned(docs)).collect()
        assert len(got) == docs.count()
        assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 6))
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(documents, ({}, 0.0)).collect())
