"""The operators' queries over the tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity
from tidemark.llm.common import held_out, table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.html_text import extract_text
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.knn import top_k
from tidemark.llm.mixing import mix
from tidemark.llm.neighbours import nearest
from tidemark.llm.secrets import secret_scan
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.tokens import token_counts
from tidemark.llm.url_filter import filter_urls
from tidemark.llm.vector_codes import vector_codes

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.language(docs, langid.learned(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"), vocabulary=vocabulary()).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES))))
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's counts of base spans, which SQL can tell."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 but for what it takes, which is drawn."""
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's bytes."""
    return op10_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_language, op3_top_k, op4_secrets, op5_jaccard, op6_decontaminate, op7_url_filter, op8_mixing, op9_html_text, op10_token_counts, op11_nearest, op12_vector_codes, op13_spelling, secret_counts, mix_targets, text_bytes)}

ORACLE_SQL = {
    "op3_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 20
""",
    "op5_jaccard": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM l WHERE l.a = doc_id) AS n_links FROM n JOIN r ON r.a = doc_id GROUP BY doc_id
""",
    "op6_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: w[i:i + least(13, len(w)) - 1])) AS g FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM bw),
dp AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k),
m AS (SELECT dp.doc_id, i, dp.k, item_id FROM dp JOIN bw ON dp.k = bw.k AND dp.w[i:i + dp.k - 1] = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op7_url_filter": """
WITH u AS (SELECT page_id,
             coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op12_vector_codes": """
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, m, v[m * 4 + 1:m * 4 + 4] AS s FROM k, range(16) t(m)),
b0 AS MATERIALIZED (SELECT m, r - 1 AS e, s FROM p WHERE r <= 64),
a0 AS (SELECT p.r, p.m, any_value(p.s) AS s, arg_min(e, (list_sum(list_transform(list_zip(p.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e)) AS e FROM p JOIN b0 b ON p.m = b.m GROUP BY p.r, p.m),
n0 AS (SELECT m, e, list_transform(range(1, 5), lambda i: floor(list_sum(list_transform(l, lambda x: x[i]))::DOUBLE / len(l))::BIGINT) AS s FROM (SELECT m, e, list(s) AS l FROM a0 GROUP BY m, e)),
b1 AS MATERIALIZED (SELECT m, e, coalesce(n.s, b.s) AS s FROM b0 b LEFT JOIN n0 n USING (m, e)),
a1 AS (SELECT p.r, p.m, any_value(p.s) AS s, arg_min(e, (list_sum(list_transform(list_zip(p.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e)) AS e FROM p JOIN b1 b ON p.m = b.m GROUP BY p.r, p.m),
n1 AS (SELECT m, e, list_transform(range(1, 5), lambda i: floor(list_sum(list_transform(l, lambda x: x[i]))::DOUBLE / len(l))::BIGINT) AS s FROM (SELECT m, e, list(s) AS l FROM a1 GROUP BY m, e)),
b2 AS MATERIALIZED (SELECT m, e, coalesce(n.s, b.s) AS s FROM b1 b LEFT JOIN n1 n USING (m, e)),
a2 AS (SELECT p.r, p.m, min((list_sum(list_transform(list_zip(p.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e)) AS best FROM p JOIN b2 b ON p.m = b.m GROUP BY p.r, p.m),
c AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY m) AS code, sum(best[1])::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY m, e)) FROM b2) AS codebooks_sha256 FROM c JOIN k USING (r)
""",
    "op13_spelling": r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS crc FROM range(256) r(i)),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS of, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT of, run, count(*) AS n, hex(encode(of || ':' || run)) AS x FROM d GROUP BY of, run),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, b: xor(a // 256, crc[(xor(a, b) % 256 + 1)::BIGINT]))) AS h FROM g, t),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM h) WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
c AS MATERIALIZED (SELECT word, n, translate(word, 'ßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_{|}') AS k FROM w),
v AS (SELECT word, n, k, unnest(list_append(list_transform(range(1, len(k) + 1), lambda i: k[1:i - 1] || k[i + 1:]), k)) AS x FROM c),
e AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.x = b.x AND a.word <> b.word WHERE levenshtein(a.k, b.k) = 1),
s AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM e GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM w LEFT JOIN s USING (word)),
l AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT l.word, f.word, f.form FROM l JOIN f ON f.word = l.next)
SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n FROM f JOIN l ON l.word = f.word AND l.next IS NULL
""",
    "secret_counts": r"""
SELECT doc_id,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 8)) AS n_assign,
       len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16)) AS n_access,
       len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: len(x) >= 32)) AS n_hex
FROM documents
""",
    "mix_targets": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source) AS k FROM s),
l AS (SELECT a.k, (SELECT sum(source_size) FROM s) AS total, coalesce((SELECT sum(3 * source_size) FROM o b WHERE b.k < a.k), 0) AS used, (SELECT sum(w) FROM o b WHERE b.k >= a.k) AS left_w, 3 * a.source_size / a.w AS most FROM o a),
v AS (SELECT (total - used) / left_w AS level FROM l WHERE (total - used) / left_w <= most ORDER BY k LIMIT 1)
SELECT doc_id, size, source_size, round(least(3 * source_size, w * (SELECT level FROM v)), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
""",
    "text_bytes": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents",
}
