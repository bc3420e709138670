"""Queries for schema differences, migration history and text normalisation, over small literal relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import history, impact, schema_diff
from tidemark.plans.registry import query
from tidemark.sources import files

OLD = [
    ("users", "id", 0, "INTEGER", False, None), ("users", "email", 1, "VARCHAR(100)", False, None), ("users", "nick", 2, "TEXT", True, None), ("users", "made", 3, "TIMESTAMP", True, "now()"),
    ("posts", "id", 0, "INTEGER", False, None), ("posts", "body", 1, "TEXT", True, None),
    ("items", "id", 0, "BIGINT", False, None), ("items", "price", 1, "FLOAT8", True, "0"), ("items", "name", 2, "TEXT", True, None),
]
NEW = [
    ("users", "id", 0, "BIGINT", False, None), ("users", "email", 1, "VARCHAR(255)", False, None), ("users", "alias", 2, "TEXT", True, None), ("users", "made", 3, "timestamp without time zone", True, "CURRENT_TIMESTAMP"),
    ("tags", "id", 0, "INTEGER", False, None),
    ("goods", "id", 0, "int8", False, None), ("goods", "price", 1, "double precision", True, "0"), ("goods", "title", 2, "TEXT", True, None),
]
FILES = [("0001", [], "a1", "0001_init.sql"), ("0002", ["0001"], "b2", "0002_users.sql"), ("0003", ["0001"], "c3", "0003_tags.sql"), ("0010", ["0002", "0003"], "d4", "0010_goods.sql")]
APPLIED = [("0001", "0001_init.sql", "a1"), ("0002", "0002_users.sql", "zz")]
INDEXES = ([("users", "i1", ["email"], True), ("users", "i2", ["nick"], False), ("posts", "i3", ["id"], False)], [("users", "i1", ["email"], False), ("users", "i2", ["nick"], False), ("users", "i4", ["made"], False)])


def old(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OLD, schema_diff.COLUMNS)


def new(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NEW, schema_diff.COLUMNS)


def migration_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "version string, depends_on array<string>, checksum string, filename string")


def applied(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(APPLIED, "version string, filename string, checksum string")


def values(rows: list[tuple], names: str) -> str:
    """A VALUES list of literal rows."""

    def told(v: object) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(map(told, v)) + "]" if v else "[]::VARCHAR[]"
        return "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) v({names})"


#: The literal columns as they are after normalisation, spelled out apart from the code that normalises.
PLAIN = {"INTEGER": "integer", "BIGINT": "bigint", "int8": "bigint", "FLOAT8": "double", "double precision": "double", "TEXT": "text", "TIMESTAMP": "timestamp", "timestamp without time zone": "timestamp", "VARCHAR(100)": "varchar(100)", "VARCHAR(255)": "varchar(255)"}
NOW = {"now()": "now", "CURRENT_TIMESTAMP": "now"}
SIDES = ", ".join(f"{side} AS (SELECT * FROM {values([(t, n, PLAIN[k], b, NOW.get(x, x)) for t, n, _, k, b, x in rows], 't, n, k, b, x')})" for side, rows in (("o", OLD), ("w", NEW)))
DIFF = f"""WITH {SIDES}, j AS (SELECT o.t, o.n, o.k AS ok, w.k AS wk, o.b AS ob, w.b AS wb, o.x AS ox, w.x AS wx, w.t AS wt FROM o JOIN w ON o.t = w.t AND o.n = w.n)
SELECT 'create_table' AS op, t AS "table", NULL AS name, NULL AS detail FROM (SELECT DISTINCT t FROM w) WHERE t NOT IN (SELECT t FROM o)
UNION ALL SELECT 'drop_table', t, NULL, NULL FROM (SELECT DISTINCT t FROM o) WHERE t NOT IN (SELECT t FROM w)
UNION ALL SELECT 'add_column', t, n, k FROM w WHERE t IN (SELECT t FROM o) AND (t, n) NOT IN (SELECT (t, n) FROM o)
UNION ALL SELECT 'drop_column', t, n, k FROM o WHERE t IN (SELECT t FROM w) AND (t, n) NOT IN (SELECT (t, n) FROM w)
UNION ALL SELECT 'alter_column_type', t, n, ok || ' -> ' || wk FROM j WHERE ok <> wk
UNION ALL SELECT 'alter_column_nullable', t, n, ob || ' -> ' || wb FROM j WHERE ob <> wb
UNION ALL SELECT 'alter_column_default', t, n, coalesce(ox, 'null') || ' -> ' || coalesce(wx, 'null') FROM j WHERE ox IS DISTINCT FROM wx"""


@query(DIFF)
def schema_diff_columns(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.diff(old(spark), new(spark))


@query("SELECT 0 AS n")
def schema_converges(spark: SparkSession, d: str) -> DataFrame:
    """A schema held against itself has no operations."""
    return schema_diff.diff(new(spark), new(spark)).agg(F.count("*").alias("n"))


@query(f"SELECT 'users' AS \"table\", 'nick' AS old, 'alias' AS \"new\", k AS type FROM (WITH {SIDES} SELECT k FROM o WHERE n = 'nick')")
def rename_candidates(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.rename_candidates(schema_diff.diff(old(spark), new(spark)))


@query(f"SELECT op, \"table\", name, detail FROM ({DIFF}) WHERE name IS NULL OR name NOT IN ('nick', 'alias') UNION ALL SELECT 'rename_column', 'users', 'nick', 'alias'")
def renames_applied(spark: SparkSession, d: str) -> DataFrame:
    ops = schema_diff.diff(old(spark), new(spark))
    return schema_diff.with_renames(ops, schema_diff.rename_candidates(ops))


@query(f"""WITH {SIDES}, g AS (SELECT * FROM o WHERE t NOT IN (SELECT t FROM w)), c AS (SELECT * FROM w WHERE t NOT IN (SELECT t FROM o)),
s AS (SELECT g.t AS old_table, c.t AS new_table, count(*) FILTER (WHERE g.n = c.n AND g.k = c.k) AS k FROM g, c GROUP BY 1, 2)
SELECT old_table, new_table, k / greatest((SELECT count(*) FROM g WHERE t = old_table), (SELECT count(*) FROM c WHERE t = new_table)) AS score FROM s WHERE score >= 0.6""")
def table_overlap(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.table_overlap(old(spark), new(spark))


@query(f"""SELECT op, "table", name, CASE WHEN op IN ('drop_table', 'drop_column') THEN 'CRITICAL' ELSE 'SAFE' END AS severity FROM ({DIFF})""")
def diff_severity(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.severity(schema_diff.diff(old(spark), new(spark))).select("op", "table", "name", "severity")


TYPE_NAMES = ["INTEGER", "int4", "SMALLINT", "BIGINT", "int8", "VARCHAR(100)", "VARCHAR(50)", "character varying(255)", "VARCHAR", "TEXT", "CHAR(3)", "NUMERIC(10,2)", "numeric(5, 2)", "DECIMAL", "REAL", "DOUBLE PRECISION", "TIMESTAMP", "timestamptz", "timestamp with time zone", "DATE", "JSON", "JSONB", "UUID", "BOOLEAN"]
#: The same types as (name, kind, size), spelled out apart from the code that reads them.
TYPE_KINDS = [("INTEGER", "i", None), ("int4", "i", None), ("SMALLINT", "i", None), ("BIGINT", "b", None), ("int8", "b", None), ("VARCHAR(100)", "v", 100), ("VARCHAR(50)", "v", 50), ("character varying(255)", "v", 255), ("VARCHAR", "v", None), ("TEXT", "t", None), ("CHAR(3)", "c", 3), ("NUMERIC(10,2)", "n", 10), ("numeric(5, 2)", "n", 5), ("DECIMAL", "n", None), ("REAL", "f4", None), ("DOUBLE PRECISION", "f8", None), ("TIMESTAMP", "s", None), ("timestamptz", "z", None), ("timestamp with time zone", "z", None), ("DATE", "d", None), ("JSON", "j", None), ("JSONB", "y", None), ("UUID", "u", None), ("BOOLEAN", "o", None)]


@query(f"""WITH k AS (SELECT * FROM {values(TYPE_KINDS, 't, k, n')})
SELECT x.t AS a, y.t AS b, CASE WHEN x.k = 'v' AND y.k = 'v' AND y.n < x.n OR x.k = 'n' AND y.k = 'n' AND y.n < x.n THEN 'CRITICAL' WHEN x.k = y.k OR x.k || y.k IN ('ib', 'vt', 'jy') THEN 'SAFE' WHEN x.k || y.k IN ('sz', 'zs') THEN 'WARN' ELSE 'CRITICAL' END AS class FROM k x, k y""")
def type_change_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every change between two of the types."""
    names = F.array(*map(F.lit, TYPE_NAMES))
    return spark.range(1).select(F.explode(names).alias("a"), names.alias("n")).select("a", F.explode("n").alias("b")).withColumn("class", schema_diff.classify_type_change(F.col("a"), F.col("b")))


@query(f"""SELECT row_number() OVER (ORDER BY list_position({list(schema_diff.OP_ORDER)}, op), "table", name NULLS FIRST)::INTEGER AS seq, op, "table" FROM ({DIFF})""")
def ops_in_order(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.ordered(schema_diff.diff(old(spark), new(spark))).select("seq", "op", "table")


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY list_position({list(schema_diff.OP_ORDER)}, op), "table", name NULLS FIRST) AS seq FROM ({DIFF})),
p AS (SELECT '[' || string_agg('{{"op":"' || op || '","table":"' || "table" || '"' || coalesce(',"name":"' || name || '"', '') || ',"severity":"' || CASE WHEN op IN ('drop_table', 'drop_column') THEN 'CRITICAL' ELSE 'SAFE' END || '"}}', ',' ORDER BY seq) || ']' AS plan FROM s)
SELECT plan, sha256(plan) AS checksum FROM p""")
def migration_plan(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.plan(schema_diff.diff(old(spark), new(spark)))


@query("SELECT * FROM (VALUES ('users', 'i1', 'recreate_index'), ('users', 'i4', 'add_index'), ('posts', 'i3', 'drop_index')) v(\"table\", name, change)")
def index_diff(spark: SparkSession, d: str) -> DataFrame:
    kind = "table string, name string, columns array<string>, unique boolean"
    return schema_diff.same_indexes(spark.createDataFrame(INDEXES[0], kind), spark.createDataFrame(INDEXES[1], kind), ["columns", "unique"])


@query("SELECT * FROM (VALUES ('rename', 'users', 'uq_mail', 'email'), ('drop', 'users', 'uq_nick', 'made,nick'), ('add', 'users', 'uq_made', 'made')) v(change, \"table\", name, columns)")
def constraint_renames(spark: SparkSession, d: str) -> DataFrame:
    kind = "table string, name string, columns array<string>"
    a = spark.createDataFrame([("users", "uq_email", ["email"]), ("users", "uq_nick", ["nick", "made"]), ("posts", "pk", ["id", "at"])], kind)
    b = spark.createDataFrame([("users", "uq_mail", ["email"]), ("users", "uq_made", ["made"]), ("posts", "pk", ["at", "id"])], kind)
    return schema_diff.constraint_diff(a, b)


@query("SELECT ['c', 'd'] AS added, ['a'] AS removed")
def enum_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(["a", "b"], ["b", "d", "c"])], "o array<string>, n array<string>")
    return rows.select(schema_diff.enum_diff(F.col("o"), F.col("n")).alias("e")).select("e.*")


@query("SELECT * FROM (VALUES ('t1', 'engine', 'merge_tree', 'replacing')) v(\"table\", field, old, \"new\")")
def immutable_options(spark: SparkSession, d: str) -> DataFrame:
    kind = "table string, engine string, partition_by string"
    a = spark.createDataFrame([("t1", "merge_tree", None), ("t2", "summing", "day")], kind)
    b = spark.createDataFrame([("t1", "replacing", None), ("t2", "summing", "day")], kind)
    return schema_diff.immutable_changes(a, b, ["engine", "partition_by"])


@query("SELECT true AS appended, false AS reordered")
def sort_key_growth(spark: SparkSession, d: str) -> DataFrame:
    key = lambda *c: F.array(*map(F.lit, c))
    return spark.range(1).select(schema_diff.key_only_grows(key("a", "b"), key("a", "b", "c")).alias("appended"), schema_diff.key_only_grows(key("a", "b"), key("b", "a", "c")).alias("reordered"))


@query("SELECT * FROM (VALUES ('t1', 'index_granularity', '1024')) v(\"table\", name, value)")
def settings_not_default(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("t1", "index_granularity", "1024"), ("t2", "index_granularity", "8192")], "table string, name string, value string")
    return schema_diff.without_default_settings(rows, spark.createDataFrame([("index_granularity", "8192")], "name string, value string"))


@query("SELECT * FROM (VALUES ('t1', NULL, 'a,b'), ('t2', 'a', 'a,b')) v(\"table\", primary_key, order_by)")
def primary_key_canonical(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.primary_key_or_null(spark.createDataFrame([("t1", "a,b", "a,b"), ("t2", "a", "a,b")], "table string, primary_key string, order_by string"))


@query("SELECT 'DROP TABLE x' AS sql")
def fresh_statements(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("CREATE  TABLE a (b INT);",), ("DROP TABLE x",)], "sql string")
    return schema_diff.fresh_statements(rows, spark.createDataFrame([("create table A (b int)",)], "sql string"))


@query("SELECT * FROM (VALUES ('drop_column', 'users', 'nick', 'app.py', 3), ('drop_column', 'users', 'nick', 'db.py', 2), ('drop_table', 'posts', NULL, 'app.py', 7), ('drop_table', 'posts', NULL, 'db.py', 1)) v(op, \"table\", name, file, line)")
def impact_lines(spark: SparkSession, d: str) -> DataFrame:
    ops = schema_diff.diff(old(spark), new(spark)).where("op IN ('drop_column', 'drop_table') AND `table` <> 'items'")
    code = spark.createDataFrame([("app.py", 3, "print(user.nick)"), ("app.py", 7, "SELECT * FROM posts p JOIN posts q"), ("db.py", 1, "Posts.query"), ("db.py", 2, "nicked")], "file string, line int, text string")
    return impact.impact(ops, code)


@query(f"SELECT version, filename FROM {values([(f[0], f[3]) for f in FILES], 'version, filename')} WHERE version NOT IN (SELECT version FROM {values([(a[0],) for a in APPLIED], 'version')})")
def pending_versions(spark: SparkSession, d: str) -> DataFrame:
    return history.pending(migration_list(spark), applied(spark)).select("version", "filename")


@query(f"SELECT f.filename FROM {values([(f[3], f[2]) for f in FILES], 'filename, c').replace(' v(', ' f(')} LEFT JOIN {values([(a[1], a[2]) for a in APPLIED], 'filename, c').replace(' v(', ' a(')} ON f.filename = a.filename WHERE a.c IS NULL OR a.c <> f.c")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return history.changed(migration_list(spark), applied(spark)).select("filename")


@query("SELECT * FROM (VALUES ('applied', 2::BIGINT), ('pending', 2), ('total', 4)) v(status, n)")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return history.status_counts(migration_list(spark), applied(spark))


@query("SELECT * FROM (VALUES ('0002'), ('0003'), ('0010')) v(version)")
def versions_to_revert(spark: SparkSession, d: str) -> DataFrame:
    return history.to_revert(migration_list(spark), "0001")


@query("SELECT '0011' AS version")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return history.next_version(migration_list(spark))


@query("SELECT '0010' AS version, 'd4' AS checksum")
def latest_migration(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(migration_list(spark), S.version_key(F.col("version"))).select("version", "checksum")


@query("""WITH RECURSIVE f(version, needs) AS (VALUES ('0001', NULL), ('0002', '0001'), ('0003', '0001'), ('0010', '0002'), ('0010', '0003')),
w(version, level) AS (SELECT version, 0 FROM f WHERE needs IS NULL UNION ALL SELECT f.version, level + 1 FROM f JOIN w ON f.needs = w.version)
SELECT version, max(level) AS level FROM w GROUP BY 1""")
def dependency_levels(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.dependency_order(migration_list(spark), complete=True)


@query("SELECT sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM (SELECT sha256(n_nationkey::VARCHAR || ';' || n_name) AS h FROM nation)")
def relation_digest(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.session import load

    return history.digest(load(spark, d, "nation"), ["n_name"], ["n_nationkey"])


TYPES = [("INT4", "integer"), ("Nullable(String)", "varchar"), ("LowCardinality(Nullable(String))", "varchar"), ("NUMERIC(10, 2)", "numeric(10,2)"), ("character varying(20) COLLATE \"C\"", "varchar(20)"), ("DateTime64(3)", "timestamp"), ("Int64", "bigint"), ("tsvector", "tsvector"), ("Decimal64(2)", "numeric(2)")]


@query(f"SELECT a, b FROM {values(TYPES, 'a, b')}")
def normal_types(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t, _ in TYPES], "a string").withColumn("b", S.normal_type(F.col("a")))


SQLITE = [
    ("BIGINT", "BIGINT"), ("DOUBLE PRECISION", "DOUBLE PRECISION"), ("JSONB", "TEXT"), ("bytea", "BLOB"), ("NUMERIC(8,2)", "NUMERIC"), ("tsvector", "TEXT"), ("boolean", "boolean"), ("bool", "BOOLEAN"), ("TIMESTAMPTZ", "DATETIME"), ("timestamp  with time zone", "DATETIME"),
    ("TIMESTAMP", "TIMESTAMP"), ("Nullable(Int64)", "INTEGER"), ("LowCardinality(Nullable(String))", "TEXT"), ("DateTime64(3)", "DATETIME"), ("FixedString(16)", "TEXT"), ("Array(Int32)", "TEXT"), ("varchar(20)", "varchar(20)"), ("serial", "INTEGER"), ("Float64", "REAL"),
]


@query(f"SELECT a, b FROM {values(SQLITE, 'a, b')}")
def sqlite_types(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t, _ in SQLITE], "a string").withColumn("b", S.sqlite_type(F.col("a")))


@query("SELECT * FROM (VALUES ('now()', 'now'), ('CURRENT_TIMESTAMP', 'now'), ('''x''::text', 'x'), ('(5)', '5'), ('0', '0'), ('true', 'TRUE'), ('False', 'FALSE'), ('''true''', 'TRUE')) v(a, b)")
def normal_defaults(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("now()",), ("CURRENT_TIMESTAMP",), ("'x'::text",), ("(5)",), ("0",), ("true",), ("False",), ("'true'",)], "a string").withColumn("b", S.normal_default(F.col("a")))


@query("SELECT * FROM (VALUES ('at + INTERVAL 30 DAY', 'at + toIntervalDay(30)'), ('at + INTERVAL ''1'' YEAR DELETE', 'at + toIntervalYear(1) DELETE')) v(a, b)")
def interval_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("at + INTERVAL 30 DAY",), ("at + INTERVAL '1' YEAR DELETE",)], "a string").withColumn("b", S.interval_calls(F.col("a")))


@query("SELECT * FROM (VALUES (0, 'CREATE TABLE a (x TEXT DEFAULT '';'')'), (1, 'DROP TABLE b')) v(k, sql)")
def split_statements(spark: SparkSession, d: str) -> DataFrame:
    script = "-- first\nCREATE TABLE a (x TEXT DEFAULT ';');\n\nDROP TABLE b;\n"
    return spark.createDataFrame([(script,)], "s string").select(F.posexplode(S.statements(F.col("s"))).alias("k", "sql"))


@query("SELECT * FROM (VALUES ('CREATE TABLE a (b INT)', 'DROP TABLE a'), ('create unique index ix ON a (b)', 'DROP INDEX ix'), ('ALTER TABLE a ADD COLUMN c INT', 'ALTER TABLE a DROP COLUMN c')) v(a, b)")
def reversed_statements(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("CREATE TABLE a (b INT)",), ("create unique index ix ON a (b)",), ("ALTER TABLE a ADD COLUMN c INT",)], "a string").withColumn("b", S.reverse_statement(F.col("a")))


@query("SELECT 'pg://u:***@h/db' AS url, 'add_user_table' AS slug, 'SELECT a FROM d.t' AS q, 'lower(email)' AS ix")
def text_rules(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(S.masked_password(F.lit("pg://u:s3cret@h/db")).alias("url"), S.slug(F.lit("Add user-table!")).alias("slug"), S.qualified(F.lit("SELECT a FROM t"), "d").alias("q"), F.concat(F.lit("lower("), S.normal_index_column(F.lit('"Email"::text')), F.lit(")")).alias("ix"))


@query("SELECT * FROM (VALUES ('users', 'email', 'varchar(100)', false), ('users', 'id', 'integer', false)) v(\"table\", name, type, nullable)")
def snapshot_columns(spark: SparkSession, d: str) -> DataFrame:
    """A schema written as a snapshot and read back."""
    rows = spark.createDataFrame([("users", "id", "integer", False, None), ("users", "email", "varchar(100)", False, None)], "table string, name string, type string, nullable boolean, default string")
    return files.snapshot_columns(files.snapshot_of(rows)).select("table", "name", "type", "nullable")


@query("SELECT * FROM (VALUES ('0002', 'upgrade', 0, 'CREATE TABLE t (a INT)'), ('0002', 'upgrade', 1, 'CREATE INDEX i ON t (a)'), ('0002', 'rollback', 0, 'DROP TABLE t')) v(version, section, seq, sql)")
def parsed_migrations(spark: SparkSession, d: str) -> DataFrame:
    text = "-- depends_on: 0001\n-- description: t\n-- upgrade\nCREATE TABLE t (a INT);\nCREATE INDEX i ON t (a);\n-- rollback\nDROP TABLE t;\n"
    return files.parsed(spark.createDataFrame([("0002_t.sql", text)], "filename string, text string")).select("version", "section", "seq", "sql")


STATEMENTS = [
    (1, "CREATE TABLE goods (id INT8, price DOUBLE PRECISION DEFAULT 0, title TEXT)", "DROP TABLE goods", False), (2, "CREATE TABLE tags (id INTEGER NOT NULL)", "DROP TABLE tags", False),
    (3, "ALTER TABLE users RENAME COLUMN nick TO alias", "ALTER TABLE users RENAME COLUMN alias TO nick", False), (4, "ALTER TABLE users ALTER COLUMN email TYPE varchar(255)", "ALTER TABLE users ALTER COLUMN email TYPE varchar(100)", False),
    (5, "ALTER TABLE users ALTER COLUMN id TYPE bigint", "ALTER TABLE users ALTER COLUMN id TYPE integer", False), (6, "DROP TABLE items", "CREATE TABLE items ()", True), (7, "DROP TABLE posts", "CREATE TABLE posts ()", True),
]


@query(f"SELECT * FROM {values(STATEMENTS, 'seq, sql, rollback, irreversible').replace('INT8,', 'INT8 NOT NULL,')}")
def rendered_ops(spark: SparkSession, d: str) -> DataFrame:
    """A difference as statements, renames confirmed."""
    from tidemark.operators.render import rendered

    ops = schema_diff.diff(old(spark), new(spark))
    return rendered(schema_diff.with_renames(ops, schema_diff.rename_candidates(ops)), new(spark)).select("seq", "sql", "rollback", "irreversible")


@query("SELECT * FROM (VALUES ('a', 'x', 'int'), ('a', 'z', 'TEXT'), ('b', 'k', 'BIGINT')) v(\"table\", name, type)")
def columns_with_pending(spark: SparkSession, d: str) -> DataFrame:
    columns = spark.createDataFrame([("a", "x", "int"), ("a", "y", "int"), ("b", "old", "int")], "table string, name string, type string")
    pending = [(1, "ALTER TABLE a ADD COLUMN z TEXT;"), (2, "alter table a drop column y"), (3, "DROP TABLE IF EXISTS b"), (4, "ALTER TABLE b ADD k BIGINT")]
    return schema_diff.with_pending(columns, spark.createDataFrame(pending, "seq int, sql string"))
