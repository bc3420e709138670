import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as an operator may meet them: nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and looked at the moon", "en", "a", 7), (1, "the cat sat on the mat and looked at the moon", "en", "a", 7), (2, None, None, None, 7), (3, "", "en", "a", 7),
        (None, "a text without an id", "en", "b", 7), (4, "word " * 40_000, "en", "b", 7), (5, "\x00\x0b 12 !! é中👍", "fr", None, 7), (6, " \t\n", "de", "", 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int").selectExpr("*", "1 AS n_tokens", "2 AS score", "3 AS size", "4 AS row", "5 AS n", "6 AS spans", "7 AS host", "8 AS target")


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")
