from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.common import LOWER, table


def test_stages_keep_the_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        n.append(docs.count())
    assert n[1] < n[0] and n[2] < n[1] and n[3] <= n[2] and n[4] == n[3]
    assert docs.where("text LIKE '%[SECRET]%'").count() > 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert 0 < mixed.count() <= n[4] and mixed.where("taken <> copies * size OR copies < 1").count() == 0


def test_run_gives_the_last_stage(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*table(spark, sf, "documents").columns, "size", "source_size", "target", "copies", "taken"]
    assert got.where("text IS NULL OR copies < 1").count() == 0


def test_stages_on_odd_rows(spark, sf, documents, empty):
    """Nulls, empty and repeated rows, and extra columns that clash with those the operators make."""
    clashing = documents.withColumns({"row": F.col("id"), "masked_text": F.lit("m"), "h": F.lit(1), "of_id": F.lit(2), "copies": F.lit(3), "predicted": F.lit(0), "contaminated": F.lit(True), "key": F.lit("k"), "nth": F.lit(9), "component": F.lit(1), "n_chars": F.lit(5)})
    plain = documents.selectExpr("doc_id", "text", "lang", "source", "length(text)::bigint AS n_chars")
    for rows in (plain, clashing, clashing.where("false")):
        docs = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, sf), name)
            assert docs.columns == rows.columns
        mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert mixed.columns == [*(c for c in rows.columns if c not in ("size", "target", "copies")), "size", "source_size", "target", "copies", "taken"]
        mixed.collect()
        if rows is plain:
            assert docs.where("doc_id = 1").count() == 1 and docs.where("doc_id IS NULL").count() == 1 and docs.where("doc_id = 2 AND text IS NULL").count() == 1


def test_rows_without_an_id_and_repeated_ids_stay_apart(spark, sf):
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(1) + " more"), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(4)), (None, text(4)), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    got = sorted((r.doc_id or 0, r.text[:7]) for r in kept.collect())
    assert got == [(0, "word1x0"), (0, "word2x0"), (5, ""), (5, ""), (7, "word3x0"), (7, "word4x0")]
    mixed = corpus_pipeline.mix_sources(spark, docs.union(docs), sf)
    assert mixed.where("text = ''").count() == 0 and mixed.select("text").distinct().count() == 5 and mixed.agg(F.sum("taken")).first()[0] == 422


def test_stages_against_brute_force(spark, sf):
    """Each stage's rows on the small tables, from those that the stage before it left: near copies by all pairs of sets, benchmark
    windows by search, masks by the spans of each text, and the mix by its targets."""
    from tests.llm.test_table_operators import brute_components, brute_hits
    from tidemark.llm import secrets

    docs = {}
    frame = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.written(stage(spark, frame, sf), name)
        docs[name] = {r.doc_id: r.text for r in frame.collect()}
        assert len(docs[name]) == frame.count()
    found = brute_components(docs["toxicity"].items())
    assert docs["near_duplicates"] == {i: docs["toxicity"][i] for i, (_, part, _) in found.items() if part == i}
    hits = brute_hits(docs["near_duplicates"].items(), [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    assert docs["decontamination"] == {i: t for i, t in docs["near_duplicates"].items() if not hits[i][3]}
    words = secrets.Words(secrets.vocabulary_words(corpus_pipeline.vocabulary()))
    assert docs["secrets"] == {i: t and secrets.masked(t, secrets.spans(t, words)) for i, t in docs["decontamination"].items()}
    mixed = corpus_pipeline.mix_sources(spark, frame, sf).collect()
    sizes, taken, targets = {}, {}, {r.source: r.target for r in mixed}
    for r in frame.collect():
        sizes.setdefault(r.source, []).append(len((r.text or "").encode().translate(LOWER).split()))
    for r in mixed:
        assert r.text == docs["secrets"][r.doc_id] and r.taken == r.copies * r.size and 0 < r.taken <= 3 * r.size and r.source_size == sum(sizes[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= max(sizes[s]) / 2 + 1e-6 for s in targets) and len({r.doc_id for r in mixed}) == len(mixed)
