import pytest

from tests.compare import same_as_sql
from tidemark.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, duck, name):
    same_as_sql(queries.QUERIES[name](spark, sf), duck, queries.ORACLE_SQL[name])


CONTRACT = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"], "op2_language": ["doc_id", "held_out", "lang_pred", "score"], "op3_top_k": ["query_id", "rank", "vec_id", "score"],
    "op4_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op5_jaccard": ["doc_id", "n_shingles", "component_id", "n_links"],
    "op6_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op7_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"], "op9_html_text": ["page_id", "url", "text", "n_chars"], "op10_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op11_nearest": ["query_id", "rank", "vec_id", "score"], "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"], "op13_spelling": ["word", "form", "root", "n", "n_near", "form_n"],
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_query_returns_its_columns(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).columns == CONTRACT[name]
