import random

from tidemark.operators import impact

OPS = [("drop_column", "users", "nick", "CRITICAL"), ("drop_table", "posts", None, "CRITICAL"), ("add_column", "tags", "id", "INFO")]
SOURCE = '''import x
# users.nick is old
def f(user):
    """users_table"""
    q = "nick"
    print(user.Nick, user.tags)
    return "select * from POSTS p join Posts q"
'''


def ops(spark):
    return spark.createDataFrame(OPS, "op string, table string, name string, severity string")


def test_references_by_syntax_and_by_text(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def (:\n  posts"), ("empty.py", ""), ("none.py", None)], "file string, source string")
    got = {(r.op, r.file, r.line, r.kind, r.snippet) for r in impact.references(ops(spark), files).collect()}
    assert got == {
        ("drop_column", "a.py", 5, "string_literal", "'nick'"), ("drop_column", "a.py", 6, "attribute_access", "user.Nick"),
        ("drop_table", "a.py", 7, "grep", 'return "select * from POSTS p join Posts q"'), ("drop_table", "bad.py", 2, "grep", "posts"),
    }
    more = {r.op for r in impact.references(ops(spark), files, verbose=True).collect()}
    assert more == {"drop_column", "drop_table", "add_column"}


def test_names_are_found_inside_of_others(spark):
    lines = spark.createDataFrame([("f", 1, "users_table"), ("f", 2, "NICKED"), ("f", 3, "-- posts"), ("f", 4, "  // posts"), ("f", 5, ""), ("f", 6, None)], "file string, line int, text string")
    assert {(r.op, r.line) for r in impact.impact(ops(spark), lines).collect()} == {("drop_column", 1), ("drop_column", 2)}


def test_all_names_in_all_lines_against_in(spark, monkeypatch):
    r = random.Random(3)
    names = {"".join(r.choice("abé ") for _ in range(r.randrange(1, 5))) for _ in range(60)} - {"", " "}
    lines = [(i, 1, "".join(r.choice("aAbBéÉ ") for _ in range(30))) for i in range(80)]
    df, targets = spark.createDataFrame(lines, "file long, line int, text string"), spark.createDataFrame([(n,) for n in [*names, None, ""]], "target string")
    want = {(f, n, text.lower().index(n)) for f, _, text in lines if text.strip() for n in names if n in text.lower()}
    for size in (1 << 20, 40):
        monkeypatch.setattr(impact, "AUTOMATON_BYTES", size)
        assert {(x.file, x.target, x["at"]) for x in impact.contained(df, targets).collect()} == want
    assert impact.contained(df, targets.where("false")).count() == 0
