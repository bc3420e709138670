"""Dependency levels, statements in order, and the replay of logs, against plain versions of them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import statements as cut
from tidemark.functions.scalars import version_key
from tidemark.operators import ddl, dependencies, objects, replay


def brute_levels(nodes, needs):
    nodes, levels = {n for n in nodes if n is not None}, {}
    while True:
        more = {n: 1 + max((levels[x] for a, x in needs if a == n and x is not None), default=-1) for n in nodes - levels.keys() if all(x in levels for a, x in needs if a == n and x is not None)}
        if not more:
            return {n: levels.get(n) for n in nodes}
        levels |= more


@pytest.mark.parametrize("seed", range(2))
def test_levels_of_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)] + [None, "n1"]
    needs = [(f"n{a}", f"n{b}") for a in range(60) for b in r.sample(range(60), r.choice([0, 1, 1, 2, 3])) if b < a or r.random() < 0.02] + [("n5", "none"), (None, "n1"), ("n7", None), ("n9", "n9")]
    got = dependencies.dependency_levels(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(needs, "id string, need string"))
    assert {x.id: x.level for x in got.collect()} == brute_levels(nodes, needs)


def test_no_nodes_have_no_levels(spark):
    none = spark.createDataFrame([], "id string, need string")
    assert dependencies.dependency_levels(none, none).count() == 0


def test_numbers_run_through_all_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("x"))
    got = dependencies.numbered(rows, [F.col("k")]).collect()
    assert sorted((r.k, r.seq) for r in got) == [(i, i + 1) for i in range(1000)]


COLUMN = {"type": "int", "nullable": "true"}
OLD = [
    ("table", "a", "a", {}), ("column", "a", "id", COLUMN), ("column", "a", "Mixed Name", COLUMN), ("unique", "a", "uq_a", {"columns": "id"}), ("table", "gone", "gone", {}), ("column", "gone", "a_id", COLUMN),
    ("foreign_key", "gone", "fk_gone", {"columns": "a_id", "referenced_table": "a", "referenced_columns": "id"}), ("view", "", "v1", {"select": "SELECT id FROM a"}), ("view", "", "v2", {"select": "SELECT id FROM v1"}),
    ("enum", "", "mood", {"values": "sad,it's,ok"}), ("column", "a", "m", {"type": "mood"}), ("table", "r", "r", {"engine": "Log"}), ("column", "r", "a", COLUMN | {"position": "0"}), ("column", "r", "old", COLUMN | {"position": "1"}), ("index", "r", "ir", {"columns": "a"}),
]
NEW = [
    ("table", "a", "a", {}), ("column", "a", "id", COLUMN), ("unique", "a", "uq_a", {"columns": "id"}), ("column", "a", "m", {"type": "mood"}), ("enum", "", "mood", {"values": "ok,it's"}), ("enum", "", "size", {"values": "s,l"}),
    ("table", "n", "n", {}), ("column", "n", "a_id", COLUMN | {"position": "0"}), ("column", "n", "order", {"type": "size", "position": "1"}), ("unique", "n", "uq", {"columns": "a_id"}), ("index", "n", "ix", {"columns": "a_id,order"}),
    ("foreign_key", "n", "fk", {"columns": "a_id", "referenced_table": "a", "referenced_columns": "id"}), ("foreign_key", "n", "fk0", {"columns": "a_id", "referenced_table": "a"}),
    ("view", "", "v0", {"select": "SELECT a_id FROM n"}), ("view", "", "v1", {"select": "SELECT a_id FROM v0"}),
    ("table", "r", "r", {"engine": "Memory"}), ("column", "r", "b", COLUMN | {"position": "0"}), ("column", "r", "a", COLUMN | {"position": "1"}), ("column", "r", "c", COLUMN | {"position": "2"}), ("index", "r", "ir", {"columns": "a"}), ("unique", "r", "ur", {"columns": "b"}),
]


def test_statements_come_in_an_order_that_works(spark):
    a, b = (spark.createDataFrame(x, objects.OBJECTS) for x in (OLD, NEW))
    rows = sorted(ddl.statements(objects.object_diff(a, b), a, b).collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1))
    sql = [r.sql for r in rows]
    assert set(sql) == {
        "DROP VIEW v2", "DROP VIEW v1", "ALTER TABLE gone DROP CONSTRAINT fk_gone", "CREATE TYPE size AS ENUM ('s', 'l')", "CREATE TABLE n (a_id INT, \"order\" SIZE)",
        "ALTER TYPE mood RENAME TO mood__old; CREATE TYPE mood AS ENUM ('ok', 'it''s'); ALTER TABLE a ALTER COLUMN m TYPE mood USING m::text::mood; DROP TYPE mood__old",
        "CREATE TABLE r__new (b INT, a INT, c INT); INSERT INTO r__new (a) SELECT a FROM r; ALTER TABLE r RENAME TO r__old; ALTER TABLE r__new RENAME TO r",
        'CREATE INDEX ix ON n (a_id,"order")', "DROP INDEX ir", "CREATE INDEX ir ON r (a)", "ALTER TABLE r ADD CONSTRAINT ur UNIQUE (b)", "ALTER TABLE n ADD CONSTRAINT uq UNIQUE (a_id)", "ALTER TABLE n ADD CONSTRAINT fk FOREIGN KEY (a_id) REFERENCES a (id)",
        "ALTER TABLE n ADD CONSTRAINT fk0 FOREIGN KEY (a_id) REFERENCES a", "CREATE VIEW v0 AS SELECT a_id FROM n", "CREATE VIEW v1 AS SELECT a_id FROM v0", 'ALTER TABLE a DROP COLUMN "Mixed Name"', "DROP TABLE gone",
    }
    before = lambda x, y: sql.index(next(s for s in sql if s.startswith(x))) < sql.index(next(s for s in sql if s.startswith(y)))
    for x, y in (("DROP VIEW v2", "DROP VIEW v1"), ("DROP VIEW v1", "CREATE VIEW v1"), ("CREATE VIEW v0", "CREATE VIEW v1"), ("CREATE TABLE n", "CREATE VIEW v0"), ("CREATE TYPE size", "CREATE TABLE n"), ("CREATE TABLE n", "ALTER TABLE n ADD CONSTRAINT fk "), ("ALTER TABLE gone DROP CONSTRAINT", "DROP TABLE gone"), ("CREATE TABLE r__new", "CREATE INDEX ir"), ("DROP INDEX ir", "CREATE TABLE r__new")):
        assert before(x, y), (x, y)
    held = a.where("kind = 'column'").select("table", "name", F.col("props.type").alias("type"))
    left = replay.replayed(held, spark.createDataFrame([(r.seq, r.sql) for r in rows], "seq long, sql string")).where("kind = 'column' AND table <> 'r__old'")
    assert {(r.table, r.name) for r in left.collect()} == {(t, n) for k, t, n, _ in NEW if k == "column"}


def test_objects_in_a_cycle_are_told_without_a_level(spark):
    cycle = [("view", "", "x", {"select": "SELECT 1 FROM y"}), ("view", "", "y", {"select": "SELECT 1 FROM x"}), ("table", "t", "t", {})]
    b = spark.createDataFrame(cycle, objects.OBJECTS)
    rows = ddl.statements(objects.object_diff(b.where("false"), b), b.where("false"), b).collect()
    assert {(r.name, r.level) for r in rows} == {("x", None), ("y", None), ("t", 0)}


def brute_replay(columns, log):
    """Statement by statement: tables are lists of [table, {column: type}]."""
    tables = {}
    for t, c, kind in columns:
        tables.setdefault(t, {})[c] = kind
    for what, t, *rest in log:
        cols = tables.get(t)
        if what == "create":
            tables.setdefault(t, dict(rest[0]))
        elif what == "add":
            tables.setdefault(t, {}).setdefault(*rest)
        elif cols is None:
            continue
        elif what == "drop table":
            del tables[t]
        elif what == "rename table" and rest[0] not in tables:
            tables[rest[0]] = tables.pop(t)
        elif what == "drop":
            cols.pop(rest[0], None)
        elif what == "rename" and rest[0] in cols and rest[1] not in cols:
            cols[rest[1]] = cols.pop(rest[0])
        elif what == "type" and rest[0] in cols:
            cols[rest[0]] = rest[1]
    return {(t, c, k) for t, cols in tables.items() for c, k in cols.items()}


SAID = {
    "create": lambda t, cols: f"CREATE TABLE IF NOT EXISTS {t} ({', '.join(f'{c} {k} NOT NULL' for c, k in cols)}, PRIMARY KEY (x))", "add": lambda t, c, k: f"alter table {t} add column if not exists {c} {k} DEFAULT ';'",
    "drop table": lambda t: f"DROP TABLE IF EXISTS {t};", "rename table": lambda t, u: f"ALTER TABLE {t} RENAME TO {u}", "drop": lambda t, c: f'ALTER TABLE "{t}" DROP COLUMN "{c}"', "rename": lambda t, c, d: f"ALTER TABLE {t} RENAME COLUMN {c} TO {d}",
    "type": lambda t, c, k: f"ALTER TABLE {t} ALTER COLUMN {c} TYPE {k}",
}


@pytest.mark.parametrize("seed", range(3))
def test_logs_are_replayed_as_statement_by_statement(spark, monkeypatch, seed):
    monkeypatch.setattr(replay, "RUN", 7)
    r = random.Random(seed)
    tables, columns, kinds = [f"t{i}" for i in range(5)], [f"c{i}" for i in range(4)], ["int", "numeric(10,2)", "varchar(5)"]
    start = [("t0", "c0", "int"), ("t1", "c1", "text")]
    log, now = [], brute_replay(start, [])
    while len(log) < 60:
        t, c = r.choice(tables), r.choice(columns)
        there = {x for x, _, _ in now}
        one = r.choice([("create", t, [(x, r.choice(kinds)) for x in r.sample(columns, 2)]), ("add", t, c, r.choice(kinds)), ("drop table", t), ("rename table", t, r.choice(tables)), ("drop", t, c), ("rename", t, c, r.choice(columns)), ("type", t, c, r.choice(kinds))])
        # what no database takes isn't in logs
        if one[0] in ("rename table", "rename") and (one[-1] in there or any((t, one[-1]) == x[:2] for x in now) or (one[0] == "rename" and (t, c) not in {x[:2] for x in now}) or t not in there):
            continue
        if one[0] != "create" and one[0] != "add" and t not in there or (one[0] in ("drop", "rename") and sum(x[0] == t for x in now) < 2) or one[0] == "add" and t not in there:
            continue
        log.append(one)
        now = brute_replay(start, log)
    sql = [(i, SAID[what](t, *rest)) for i, (what, t, *rest) in enumerate(log)]
    got = replay.replayed(spark.createDataFrame(start, "table string, name string, type string"), spark.createDataFrame(sql, "seq int, sql string"))
    assert {(x.table, x.name, x.type) for x in got.where("kind = 'column'").collect()} == now


@pytest.mark.parametrize("seed", range(2))
def test_hot_names_are_replayed_in_runs(spark, monkeypatch, seed):
    """With every name cut into runs of few statements the same is left as with none cut."""
    r = random.Random(seed)
    tables, columns, kinds, log = ["t", "u"], ["a", "b", "c"], ["int", "date", "text"], []
    for _ in range(150):
        t, c = r.choice(tables), r.choice(columns)
        makes, drops, moves = ("create", t, [(x, r.choice(kinds)) for x in columns[:2]]), ("drop table", t), ("rename table", t, r.choice(tables))
        log.append(r.choice([makes, makes, drops, moves] + 3 * [("add", t, c, r.choice(kinds)), ("drop", t, c), ("rename", t, c, r.choice(columns)), ("type", t, c, r.choice(kinds))]))
    sql = spark.createDataFrame([(i, SAID[what](t, *rest)) for i, (what, t, *rest) in enumerate(log)], "seq int, sql string")
    start = spark.createDataFrame([("t", "a", "int"), ("u", "c", "int")], "table string, name string, type string")
    left = lambda: sorted(tuple(x) for x in replay.replayed(start, sql).collect())
    whole = left()
    monkeypatch.setattr(replay, "HOT", 0)
    monkeypatch.setattr(replay, "RUN", 4)
    assert whole and left() == whole


def test_a_table_that_is_made_again_stays_whatever_its_width(spark):
    made = lambda c: f"CREATE TABLE t ({', '.join(f'{c}{i} int' for i in range(600))})"
    got = replay.replayed(spark.createDataFrame([], "table string, name string, type string"), spark.createDataFrame([(1, made("a")), (2, made("b"))], "seq int, sql string"))
    assert sorted(x.name for x in got.collect()) == sorted(f"a{i}" for i in range(600))


def test_a_log_is_written_once_for_each_of_its_sorts(spark, monkeypatch):
    names, kept = [], replay.kept
    monkeypatch.setattr(replay, "kept", lambda df, name: names.append(name) or kept(df, name))
    log = [(1, "CREATE TABLE t (a int, b text)"), (2, "ALTER TABLE t RENAME COLUMN a TO c"), (3, "ALTER TABLE t RENAME TO u"), (4, "ALTER TABLE u ADD d date"), (5, "CREATE INDEX ix ON u (c)"), (6, "DROP INDEX ix")]
    got = replay.replayed(spark.createDataFrame([], "table string, name string, type string"), spark.createDataFrame(log, "seq int, sql string"))
    assert {tuple(x) for x in got.collect()} == {("u", "column", "c", "int"), ("u", "column", "b", "text"), ("u", "column", "d", "date")}
    assert sorted(names) == ["events", "inner", "inside", "start", "tables"]


def test_scripts_are_cut_outside_of_quotes_and_comments(spark):
    cases = {
        "INSERT INTO t VALUES ('a--b'); SELECT 1": ["INSERT INTO t VALUES ('a--b')", "SELECT 1"], 'a ";" b; c /* ; */ d; $$ x; y $$ e;': ['a ";" b', "c  d", "$$ x; y $$ e"],
        "-- first;\nA 'it''s;';\n\nB;": ["A 'it''s;'", "B"], "$f$ a; $$ b $f$; x": ["$f$ a; $$ b $f$", "x"], "it's; b": ["it's", "b"], "": [], " ; ;": [],
    }
    got = spark.createDataFrame([(q,) for q in cases], "s string").select("s", cut(F.col("s")).alias("c")).collect()
    assert {r.s: r.c for r in got} == cases


def test_versions_with_words_have_a_place(spark):
    got = spark.createDataFrame([(v,) for v in ("2.0.1", "2.0-rc", "10", "2", "x")], "v string").orderBy(version_key(F.col("v"))).collect()
    assert [r.v for r in got] == ["x", "2", "2.0-rc", "2.0.1", "10"]
