"""Queries for migration history, rules of text and schema differences, over inputs that both engines derive from the tables.

An input is SQL that Spark and the oracle run alike; what is expected of it is told by the oracle from the same columns, without
the patterns that the library works by.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import change_classes as C
from tidemark.functions import scalars as S
from tidemark.operators import history, impact, schema_diff
from tidemark.operators.render import rendered
from tidemark.operators.rollup import select_is_safe
from tidemark.plans.registry import query
from tidemark.session import load
from tidemark.sources import files
from tidemark.sources.engines import TableKind


def made(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The rows of an input, from the tables of a folder."""
    names = set(re.findall(r"FROM (part|orders|customer)\b", sql))
    return spark.sql(re.sub(r"FROM (part|orders|customer)\b", r"FROM {\1}", sql), **{n: load(spark, d, n) for n in names})


#: Migrations: a file for each order; all but open ones are applied, some under another checksum.
VERSION = "lpad('' || o_orderkey, 8, '0')"
FILES = f"SELECT {VERSION} AS version, {VERSION} || '_x.sql' AS filename, 'c' || o_custkey AS checksum FROM orders"
APPLIED = f"SELECT {VERSION} AS version, {VERSION} || '_x.sql' AS filename, CASE WHEN o_custkey % 7 = 0 THEN 'old' ELSE 'c' || o_custkey END AS checksum FROM orders WHERE o_orderstatus <> 'O'"
DOTTED = "SELECT (o_custkey % 5) || '.' || (o_orderkey % 97) || '.' || o_orderkey AS version, 'c' || o_custkey AS checksum FROM orders"


@query(f"SELECT {VERSION} AS version, {VERSION} || '_x.sql' AS filename FROM orders WHERE o_orderstatus = 'O'")
def pending_versions(spark: SparkSession, d: str) -> DataFrame:
    return history.pending(made(spark, d, FILES), made(spark, d, APPLIED)).select("version", "filename")


@query(f"SELECT {VERSION} || '_x.sql' AS filename FROM orders WHERE o_orderstatus = 'O' OR o_custkey % 7 = 0")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return history.changed(made(spark, d, FILES), made(spark, d, APPLIED)).select("filename")


@query("SELECT 'total' AS status, count(*) AS n FROM orders UNION ALL SELECT CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'applied' END, count(*) FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return history.status_counts(made(spark, d, FILES), made(spark, d, APPLIED))


@query("SELECT lpad('' || (max(o_orderkey) + 1), 8, '0') AS version FROM orders")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return history.next_version(made(spark, d, FILES), digits=8)


@query(f"SELECT version, checksum FROM ({DOTTED.replace('FROM orders', ', o_custkey % 5 AS a, o_orderkey % 97 AS b, o_orderkey AS c FROM orders')}) ORDER BY a DESC, b DESC, c DESC LIMIT 1")
def latest_migration(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(made(spark, d, DOTTED), S.version_key(F.col("version"))).select("version", "checksum")


@query(f"{DOTTED.replace(', ' + chr(39) + 'c' + chr(39) + ' || o_custkey AS checksum', '')} WHERE o_custkey % 5 > 3 OR o_custkey % 5 = 3 AND o_orderkey % 97 >= 50")
def versions_to_revert(spark: SparkSession, d: str) -> DataFrame:
    return history.to_revert(made(spark, d, DOTTED), "3.50")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS k FROM part WHERE p_partkey >= 1), e AS (SELECT k, k // 2 AS need FROM n WHERE k > 1 UNION SELECT k, k // 3 FROM n WHERE k > 2),
l AS (SELECT k, 0 AS level FROM n WHERE k = 1 UNION SELECT e.k, l.level + 1 FROM l JOIN e ON e.need = l.k) SELECT 'v' || k AS version, max(level)::INTEGER AS level FROM l GROUP BY k""")
def dependency_levels(spark: SparkSession, d: str) -> DataFrame:
    """Migrations that need those of half and a third of their number."""
    k = F.col("p_partkey")
    needs = F.transform(F.filter(F.array(F.floor(k / 2), F.floor(k / 3)), lambda n: n >= 1), lambda n: F.concat(F.lit("v"), n))
    return schema_diff.dependency_order(load(spark, d, "part").where(k >= 1).select(F.concat(F.lit("v"), k).alias("version"), needs.alias("depends_on")), complete=True)


def cases(column: str, pairs: list[tuple[str, str]], by: str = "p_partkey") -> tuple[str, str]:
    """(input, input with what is expected): of each row one pair of (text, expected), both SQL."""
    one = lambda k: "CASE " + " ".join(f"WHEN {by} % {len(pairs)} = {i} THEN {p[k]}" for i, p in enumerate(pairs)) + " END"
    return f"SELECT DISTINCT {one(0)} AS {column} FROM part", f"SELECT DISTINCT {one(0)} AS {column}, {one(1)} AS b FROM part"


TEXTS = {
    "normal_defaults": [("'now()'", "'now'"), ("'''' || p_name || '''::text'", "p_name"), ("'(' || p_size || ')'", "'' || p_size"), ("'CURRENT_TIMESTAMP'", "'now'"), ("CASE WHEN p_size % 2 = 0 THEN 'true' ELSE '''False''' END", "CASE WHEN p_size % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END"), ("'' || p_size", "'' || p_size")],
    "interval_rewrite": [("'at + INTERVAL ' || p_size || ' DAY'", "'at + toIntervalDay(' || p_size || ')'"), ("'at + interval ''' || p_size || ''' years DELETE'", "'at + toIntervalYear(' || p_size || ') DELETE'"), ("'c' || p_size", "'c' || p_size")],
    "reversed_statements": [("'CREATE TABLE t' || p_partkey || ' (b INT)'", "'DROP TABLE t' || p_partkey"), ("'create unique index ix' || p_partkey || ' ON a (b)'", "'DROP INDEX ix' || p_partkey"), ("'ALTER TABLE a' || p_size || ' ADD COLUMN c' || p_partkey || ' INT'", "'ALTER TABLE a' || p_size || ' DROP COLUMN c' || p_partkey"), ("'CREATE OR REPLACE VIEW v' || p_partkey || ' AS SELECT 1'", "'DROP VIEW v' || p_partkey")],
    "normal_types": [("'INT4'", "'integer'"), ("'VARCHAR(' || p_size || ')'", "'varchar(' || p_size || ')'"), ("'Nullable(Decimal64(' || p_size || '))'", "'numeric(' || p_size || ')'"), ("'LowCardinality(Nullable(String))'", "'varchar'"), ("'character varying(' || p_size || ') COLLATE \"C\"'", "'varchar(' || p_size || ')'"), ("'NUMERIC(' || p_size || ', 2)'", "'numeric(' || p_size || ',2)'"), ("'JSONB'", "'jsonb'"), ("'kind' || p_size", "'kind' || p_size")],
    "sqlite_types": [("'varchar(' || p_size || ')'", "'varchar(' || p_size || ')'"), ("'NUMERIC(' || p_size || ',2)'", "'NUMERIC'"), ("'JSONB'", "'TEXT'"), ("'Nullable(Int64)'", "'INTEGER'"), ("'FixedString(' || p_size || ')'", "'TEXT'"), ("'kind' || p_size", "'TEXT'"), ("'timestamp  with time zone'", "'DATETIME'")],
    "sqlite_defaults": [("'' || p_size", "'' || p_size"), ("'now()'", "NULL"), ("'nextval(''s' || p_size || ''')'", "NULL"), ("'''' || p_brand || ''''", "'''' || p_brand || ''''"), ("''", "NULL")],
    "plural_names": [("lower(p_type)", "CASE WHEN p_type = 'ECONOMY' THEN 'economies' ELSE lower(p_type) || 's' END"), ("'drop_' || lower(p_type) || '_index'", "'drop_' || lower(p_type) || '_indexes'"), ("'add_' || lower(p_type) || '_policy'", "'add_' || lower(p_type) || '_policies'"), ("lower(p_type) || '_key'", "lower(p_type) || '_keys'"), ("lower(p_type) || '_rls'", "lower(p_type) || '_rls'")],
    "output_names": [("'sum(c' || p_size || ') AS total_' || p_partkey", "'total_' || p_partkey"), ("'c' || p_partkey", "'c' || p_partkey"), ("' CAST(a AS INT)  as  n' || p_size || ' '", "'n' || p_size"), ("'count()'", "'count()'")],
}
RULES = {"normal_defaults": S.normal_default, "interval_rewrite": S.interval_calls, "reversed_statements": S.reverse_statement, "normal_types": S.normal_type, "sqlite_types": S.sqlite_type, "sqlite_defaults": S.sqlite_default, "plural_names": S.plural, "output_names": S.output_name}


def text_query(name: str) -> None:
    told, expected = cases("a", TEXTS[name])

    def run(spark: SparkSession, d: str) -> DataFrame:
        return made(spark, d, told).withColumn("b", RULES[name](F.col("a")))

    run.__name__ = name
    query(expected)(run)


for _name in TEXTS:
    text_query(_name)


@query("""SELECT c_custkey, 'pg://' || lower(c_mktsegment) || ':***@h/db' AS url, 'add_' || lower(replace(c_name, '#', '_')) AS slug, 'SELECT a FROM d.t' || c_custkey AS q, lower(c_mktsegment) AS ix FROM customer""")
def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """Passwords masked, slugs, qualified names and index columns, for each customer."""
    c, put = load(spark, d, "customer"), F.concat
    url = put(F.lit("pg://"), F.lower("c_mktsegment"), F.lit(":s3"), F.col("c_custkey").cast("string"), F.lit("@h/db"))
    return c.select("c_custkey", S.masked_password(url).alias("url"), S.slug(put(F.lit("Add "), "c_name", F.lit("!"))).alias("slug"), S.qualified(put(F.lit("SELECT a FROM t"), "c_custkey"), "d").alias("q"), S.normal_index_column(put(F.lit('"'), "c_mktsegment", F.lit('"::text'))).alias("ix"))


@query("""SELECT p_partkey, 0 AS k, 'CREATE TABLE t' || p_partkey || ' (x TEXT DEFAULT '';' || p_name || '--'')' AS sql FROM part
UNION ALL SELECT p_partkey, 1, 'DROP TABLE b' || p_size FROM part""")
def split_statements(spark: SparkSession, d: str) -> DataFrame:
    """A script for each part, with comments and quoted signs."""
    script = F.concat(F.lit("-- first;\nCREATE TABLE t"), "p_partkey", F.lit(" (x TEXT DEFAULT ';"), "p_name", F.lit("--');\n/* ; */\nDROP TABLE b"), "p_size", F.lit(";\n"))
    return load(spark, d, "part").select("p_partkey", F.posexplode(S.statements(script)).alias("k", "sql"))


@query("""SELECT lpad('' || p_partkey, 6, '0') AS version, section, seq, sql FROM part, LATERAL (VALUES ('upgrade', 0, 'CREATE TABLE t' || p_partkey || ' (a INT)'), ('upgrade', 1, 'CREATE INDEX i ON t' || p_partkey || ' (a)'), ('rollback', 0, 'DROP TABLE t' || p_partkey)) s(section, seq, sql)""")
def parsed_migrations(spark: SparkSession, d: str) -> DataFrame:
    """A migration file for each part."""
    n = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    t = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("-- depends_on: 0001\n-- description: "), "p_name", F.lit("\n-- upgrade\nCREATE TABLE t"), t, F.lit(" (a INT);\nCREATE INDEX i ON t"), t, F.lit(" (a);\n-- rollback\nDROP TABLE t"), t, F.lit(";\n"))
    return files.parsed(load(spark, d, "part").select(F.concat(n, F.lit("_t.sql")).alias("filename"), text.alias("text"))).select("version", "section", "seq", "sql")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN []::VARCHAR[] ELSE [p_name] END AS added, CASE WHEN p_size % 2 = 0 THEN []::VARCHAR[] ELSE [p_brand] END AS removed FROM part")
def enum_changes(spark: SparkSession, d: str) -> DataFrame:
    new = F.array("p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name")))
    return load(spark, d, "part").select("p_partkey", schema_diff.enum_diff(F.array("p_brand", "p_type"), new).alias("e")).select("p_partkey", "e.*")


@query("SELECT p_partkey, ['SAFE', 'WARN', 'CRITICAL'][p_size % 3 + 1] AS class FROM part")
def enum_change_classes(spark: SparkSession, d: str) -> DataFrame:
    old, size = F.array("p_brand", "p_type"), F.col("p_size") % 3
    new = F.when(size == 0, F.array("p_type", "p_brand")).when(size == 1, F.array("p_type", "p_name", "p_brand")).otherwise(F.array("p_brand", "p_name"))
    return load(spark, d, "part").select("p_partkey", C.enum_change_class(old, new).alias("class"))


@query("SELECT 't' || p_partkey AS \"table\", 'engine' AS field, 'e' || p_size % 3 AS old, 'e' || p_size % 4 AS \"new\" FROM part WHERE p_size % 3 <> p_size % 4")
def immutable_options(spark: SparkSession, d: str) -> DataFrame:
    option = lambda n: made(spark, d, f"SELECT 't' || p_partkey AS table, 'e' || p_size % {n} AS engine, p_brand AS partition_by FROM part")
    return schema_diff.immutable_changes(option(3), option(4), ["engine", "partition_by"])


@query("SELECT p_partkey, p_size % 3 < 2 AS grows FROM part")
def sort_key_growth(spark: SparkSession, d: str) -> DataFrame:
    old, size = F.array(F.lit("a"), "p_brand"), F.col("p_size") % 3
    new = F.when(size == 0, old).when(size == 1, F.array(F.lit("a"), "p_brand", "p_type")).otherwise(F.array("p_brand", F.lit("a"), "p_type"))
    return load(spark, d, "part").select("p_partkey", schema_diff.key_only_grows(old, new).alias("grows"))


@query("SELECT 't' || p_partkey AS \"table\", 'index_granularity' AS name, '' || 1024 * p_size AS value FROM part WHERE p_size <> 8")
def settings_not_default(spark: SparkSession, d: str) -> DataFrame:
    rows = made(spark, d, "SELECT 't' || p_partkey AS table, 'index_granularity' AS name, '' || 1024 * p_size AS value FROM part")
    return schema_diff.without_default_settings(rows, spark.createDataFrame([("index_granularity", "8192")], "name string, value string"))


@query("SELECT 't' || p_partkey AS \"table\", CASE WHEN p_size % 2 = 0 THEN 'a' END AS primary_key, 'a,b' AS order_by FROM part")
def primary_key_canonical(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.primary_key_or_null(made(spark, d, "SELECT 't' || p_partkey AS table, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'a,b' END AS primary_key, 'a,b' AS order_by FROM part"))


@query("SELECT 'CREATE  TABLE t' || p_partkey || ' (b INT);' AS sql FROM part WHERE p_size % 2 = 1")
def fresh_statements(spark: SparkSession, d: str) -> DataFrame:
    known = made(spark, d, "SELECT 'create table T' || p_partkey || '  (b int)' AS sql FROM part WHERE p_size % 2 = 0")
    return schema_diff.fresh_statements(made(spark, d, "SELECT 'CREATE  TABLE t' || p_partkey || ' (b INT);' AS sql FROM part"), known)


#: Columns of two schemas: ten parts are a table; every fifth table has another name in the new one. Column c3 is renamed and c5 widened.
TABLE = "CAST(floor(p_partkey / 10) AS BIGINT)"
OLD = f"SELECT 't' || {TABLE} AS {{0}}, 'c' || p_partkey % 10 AS name, CAST(p_partkey % 10 AS INT) AS position, CASE WHEN p_partkey % 10 = 5 THEN 'varchar(10)' ELSE 'k' || p_size END AS type, true AS nullable, CAST(NULL AS {{1}}) AS default_ FROM part"
NEW = OLD.replace("'t' ||", f"CASE WHEN {TABLE} % 5 = 0 THEN 'r' ELSE 't' END ||").replace("'c' || p_partkey % 10", "CASE WHEN p_partkey % 10 = 3 THEN 'n3' ELSE 'c' || p_partkey % 10 END").replace("varchar(10)", "varchar(20)")
DIFF = f"""SELECT op, "table", name, detail FROM (
SELECT DISTINCT 'drop_table' AS op, 't' || {TABLE} AS "table", NULL AS name, NULL AS detail FROM part WHERE {TABLE} % 5 = 0
UNION ALL SELECT DISTINCT 'create_table', 'r' || {TABLE}, NULL, NULL FROM part WHERE {TABLE} % 5 = 0
UNION ALL SELECT 'drop_column', 't' || {TABLE}, 'c3', 'k' || p_size FROM part WHERE {TABLE} % 5 <> 0 AND p_partkey % 10 = 3
UNION ALL SELECT 'add_column', 't' || {TABLE}, 'n3', 'k' || p_size FROM part WHERE {TABLE} % 5 <> 0 AND p_partkey % 10 = 3
UNION ALL SELECT 'alter_column_type', 't' || {TABLE}, 'c5', 'varchar(10) -> varchar(20)' FROM part WHERE {TABLE} % 5 <> 0 AND p_partkey % 10 = 5)"""
PLACE = f"list_position({list(schema_diff.OP_ORDER)}, op)"
GRAVE = "CASE WHEN op IN ('drop_table', 'drop_column') THEN 'CRITICAL' ELSE 'SAFE' END"


def columns(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return made(spark, d, sql.format("table", "STRING")).withColumnRenamed("default_", "default")


def changes(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.diff(columns(spark, d, OLD), columns(spark, d, NEW))


@query(DIFF)
def schema_diff_columns(spark: SparkSession, d: str) -> DataFrame:
    return changes(spark, d)


@query("SELECT 0 AS n")
def schema_converges(spark: SparkSession, d: str) -> DataFrame:
    """A schema held against itself has no operations."""
    return schema_diff.diff(columns(spark, d, NEW), columns(spark, d, NEW)).agg(F.count("*").alias("n"))


@query(f"SELECT 't' || {TABLE} AS \"table\", 'c3' AS old, 'n3' AS \"new\", 'k' || p_size AS type FROM part WHERE {TABLE} % 5 <> 0 AND p_partkey % 10 = 3")
def rename_candidates(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.rename_candidates(changes(spark, d))


@query(f"SELECT * FROM ({DIFF}) WHERE op NOT IN ('drop_column', 'add_column') UNION ALL SELECT 'rename_column', 't' || {TABLE}, 'c3', 'n3' FROM part WHERE {TABLE} % 5 <> 0 AND p_partkey % 10 = 3")
def renames_applied(spark: SparkSession, d: str) -> DataFrame:
    ops = changes(spark, d)
    return schema_diff.with_renames(ops, schema_diff.rename_candidates(ops))


@query(f"""WITH n AS (SELECT {TABLE} AS t, count(*) AS n, count(*) FILTER (WHERE p_partkey % 10 NOT IN (3, 5)) AS same FROM part WHERE {TABLE} % 5 = 0 GROUP BY 1),
c AS (SELECT {TABLE} AS t, 'c' || p_partkey % 10 AS c, p_size FROM part WHERE {TABLE} % 5 = 0 AND p_partkey % 10 NOT IN (3, 5)),
s AS (SELECT a.t AS x, b.t AS y, count(*) AS k FROM c a JOIN c b ON a.c = b.c AND a.p_size = b.p_size GROUP BY 1, 2)
SELECT 't' || x AS old_table, 'r' || y AS new_table, k / greatest(a.n, b.n) AS score FROM s JOIN n a ON a.t = x JOIN n b ON b.t = y WHERE k / greatest(a.n, b.n) >= 0.6""")
def table_overlap(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.table_overlap(columns(spark, d, OLD), columns(spark, d, NEW))


@query(f"SELECT op, \"table\", name, {GRAVE} AS severity FROM ({DIFF})")
def diff_severity(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.severity(changes(spark, d)).select("op", "table", "name", "severity")


@query(f"SELECT row_number() OVER (ORDER BY {PLACE}, \"table\", name NULLS FIRST)::INTEGER AS seq, op, \"table\" FROM ({DIFF})")
def ops_in_order(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.ordered(changes(spark, d)).select("seq", "op", "table")


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY {PLACE}, "table", name NULLS FIRST) AS seq FROM ({DIFF})),
p AS (SELECT '[' || string_agg('{{"op":"' || op || '","table":"' || "table" || '"' || coalesce(',"name":"' || name || '"', '') || ',"severity":"' || {GRAVE} || '"}}', ',' ORDER BY seq) || ']' AS plan FROM s)
SELECT plan, sha256(plan) AS checksum FROM p""")
def migration_plan(spark: SparkSession, d: str) -> DataFrame:
    return schema_diff.plan(changes(spark, d))


@query(f"""WITH b AS (SELECT "table", string_agg(name || ' ' || upper(type), ', ' ORDER BY position) AS body FROM ({NEW.format('"table"', 'VARCHAR')}) GROUP BY 1),
r AS (SELECT * FROM ({DIFF}) WHERE op NOT IN ('drop_column', 'add_column') UNION ALL SELECT 'rename_column', 't' || {TABLE}, 'c3', 'n3' FROM part WHERE {TABLE} % 5 <> 0 AND p_partkey % 10 = 3)
SELECT row_number() OVER (ORDER BY {PLACE}, "table", name NULLS FIRST)::INTEGER AS seq,
  CASE op WHEN 'create_table' THEN 'CREATE TABLE ' || "table" || ' (' || body || ')' WHEN 'drop_table' THEN 'DROP TABLE ' || "table" WHEN 'rename_column' THEN 'ALTER TABLE ' || "table" || ' RENAME COLUMN c3 TO n3' ELSE 'ALTER TABLE ' || "table" || ' ALTER COLUMN c5 TYPE varchar(20)' END AS sql,
  CASE op WHEN 'create_table' THEN 'DROP TABLE ' || "table" WHEN 'drop_table' THEN 'CREATE TABLE ' || "table" || ' ()' WHEN 'rename_column' THEN 'ALTER TABLE ' || "table" || ' RENAME COLUMN n3 TO c3' ELSE 'ALTER TABLE ' || "table" || ' ALTER COLUMN c5 TYPE varchar(10)' END AS rollback,
  op = 'drop_table' AS irreversible FROM r LEFT JOIN b USING ("table")""")
def rendered_ops(spark: SparkSession, d: str) -> DataFrame:
    """A difference as statements, renames confirmed."""
    ops = changes(spark, d)
    return rendered(schema_diff.with_renames(ops, schema_diff.rename_candidates(ops)), columns(spark, d, NEW)).select("seq", "sql", "rollback", "irreversible")


@query("""SELECT 't' || p_partkey % 9 AS "table", 'ix' || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN 'drop_index' WHEN p_partkey % 5 = 0 THEN 'add_index' ELSE 'recreate_index' END AS change FROM part
WHERE NOT (p_partkey % 4 = 0 AND p_partkey % 5 = 0) AND (p_partkey % 4 = 0 OR p_partkey % 5 = 0 OR p_size % 4 <> p_size % 6)""")
def index_diff(spark: SparkSession, d: str) -> DataFrame:
    index = lambda n, k: made(spark, d, f"SELECT 't' || p_partkey % 9 AS table, 'ix' || p_partkey AS name, array('a', 'c' || p_size % {n}) AS columns FROM part WHERE p_partkey % {k} <> 0")
    return schema_diff.same_indexes(index(4, 5), index(6, 4), ["columns"])


@query("""WITH c AS (SELECT 't' || p_partkey AS t, p_size % 3 = p_size % 4 AS same, CASE WHEN p_size % 2 = 0 THEN 'un' ELSE 'uq' END || p_partkey AS now, 'uq' || p_partkey AS was, 'c1,d' || p_size % 3 AS a, 'c1,d' || p_size % 4 AS b FROM part)
SELECT 'rename' AS change, t AS "table", now AS name, a AS columns FROM c WHERE same AND was <> now UNION ALL SELECT 'drop', t, was, a FROM c WHERE NOT same UNION ALL SELECT 'add', t, now, b FROM c WHERE NOT same""")
def constraint_renames(spark: SparkSession, d: str) -> DataFrame:
    a = made(spark, d, "SELECT 't' || p_partkey AS table, 'uq' || p_partkey AS name, array('c1', 'd' || p_size % 3) AS columns FROM part")
    b = made(spark, d, "SELECT 't' || p_partkey AS table, CASE WHEN p_size % 2 = 0 THEN 'un' ELSE 'uq' END || p_partkey AS name, array('d' || p_size % 4, 'c1') AS columns FROM part")
    return schema_diff.constraint_diff(a, b)


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size % 30 >= p_size THEN 'SAFE' ELSE 'CRITICAL' END WHEN 1 THEN 'SAFE' WHEN 2 THEN 'SAFE' WHEN 3 THEN 'CRITICAL' WHEN 4 THEN 'WARN' ELSE CASE WHEN p_size % 30 >= p_size THEN 'SAFE' ELSE 'CRITICAL' END END AS class FROM part""")
def type_change_classes(spark: SparkSession, d: str) -> DataFrame:
    """Types of some length against others of another, json against jsonb both ways, timestamps with and without a zone."""
    old = "CASE p_partkey % 6 WHEN 0 THEN 'varchar(' || p_size || ')' WHEN 1 THEN 'varchar(' || p_size || ')' WHEN 2 THEN 'JSON' WHEN 3 THEN 'JSONB' WHEN 4 THEN 'timestamp' ELSE 'numeric(' || p_size || ', 2)' END"
    new = "CASE p_partkey % 6 WHEN 0 THEN 'character varying(' || p_size % 30 || ')' WHEN 1 THEN 'text' WHEN 2 THEN 'jsonb' WHEN 3 THEN 'json' WHEN 4 THEN 'TIMESTAMP WITH TIME ZONE' ELSE 'DECIMAL(' || p_size % 30 || ',2)' END"
    return made(spark, d, f"SELECT p_partkey, {old} AS a, {new} AS b FROM part").select("p_partkey", C.type_change_class(F.col("a"), F.col("b")).alias("class"))


OPTIONS = {"order_by": "CRITICAL", "engine_raw": "CRITICAL", "settings": "WARN", "zookeeper_path": "WARN", "dict_layout": "WARN", "ttl": "INFO", "partition_by": "INFO"}


@query(f"SELECT p_partkey, {list(OPTIONS.values())}[p_partkey % {len(OPTIONS)} + 1] AS class FROM part")
def ch_option_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of options of column-store tables."""
    name = F.element_at(F.array(*map(F.lit, OPTIONS)), (F.col("p_partkey") % len(OPTIONS) + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", C.option_change_class(name).alias("class"))


PROPERTIES = {"type": "WARN", "low_cardinality": "CRITICAL", "nullable": "CRITICAL", "codec": "WARN", "alias": "WARN", "comment": "INFO"}


@query(f"SELECT p_partkey, CASE WHEN p_partkey % {len(PROPERTIES)} = 0 AND p_size % 2 = 0 THEN 'CRITICAL' ELSE {list(PROPERTIES.values())}[p_partkey % {len(PROPERTIES)} + 1] END AS class FROM part")
def ch_column_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of properties of column-store columns; every second type has aggregate states on one side."""
    name = F.element_at(F.array(*map(F.lit, PROPERTIES)), (F.col("p_partkey") % len(PROPERTIES) + 1).cast("int"))
    old = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("AggregateFunction(sum, "), "p_brand", F.lit(")"))).otherwise(F.col("p_brand"))
    return load(spark, d, "part").select("p_partkey", C.property_change_class(name, old, F.col("p_type")).alias("class"))


KEEP, MERGE = ["MergeTree", "ReplicatedMergeTree('/p', 'r')", "Memory", "Log"], ["ReplacingMergeTree(v)", "SummingMergeTree", "Kafka"]
ENGINES = [*KEEP, *MERGE]


@query(f"SELECT p_partkey, CASE WHEN p_partkey % {len(ENGINES)} < {len(KEEP)} AND p_size % {len(ENGINES)} < {len(KEEP)} THEN 'conditional' ELSE 'irreversible' END AS rollback FROM part")
def engine_changes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a table made anew with another engine can be made back."""
    engine = lambda c: F.element_at(F.array(*map(F.lit, ENGINES)), (F.col(c) % len(ENGINES) + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", C.engine_change_class(engine("p_partkey"), engine("p_size")).alias("rollback"))


@query(f"SELECT \"table\", name, type, nullable FROM ({OLD.format(chr(34) + 'table' + chr(34), 'VARCHAR')})")
def snapshot_columns(spark: SparkSession, d: str) -> DataFrame:
    """A schema written as a snapshot and read back."""
    return files.snapshot_columns(files.snapshot_of(columns(spark, d, OLD).drop("position"))).select("table", "name", "type", "nullable")


@query("""WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
o AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS t, lower(substr(p_type, 1, 3)) AS c FROM part)
SELECT DISTINCT 'drop_column' AS op, t AS "table", c AS name, file, line::INTEGER AS line FROM l JOIN o ON contains(lower(text), t) OR contains(lower(text), c) WHERE trim(text) <> '' AND NOT regexp_matches(ltrim(text), '^(#|//|--|"{3}|''{3})')""")
def impact_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that hold the table or the column of dropped columns, named by parts."""
    ops = load(spark, d, "part").select(F.lit("drop_column").alias("op"), F.lower(F.split("p_name", " ")[1]).alias("table"), F.lower(F.substring("p_type", 1, 3)).alias("name")).distinct()
    return impact.impact(ops, impact.lines_of(load(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("source"))))


#: A log for each part: its table is made, changed, renamed and dropped, depending on its number.
LOG = """SELECT p_partkey * 10 AS seq, 'CREATE TABLE t' || p_partkey || ' (a INT NOT NULL, b VARCHAR(' || p_size || ') DEFAULT ''x,y'', PRIMARY KEY (a))' AS sql FROM part
UNION ALL SELECT p_partkey * 10 + 1, 'ALTER TABLE t' || p_partkey || ' RENAME COLUMN a TO a' || p_size FROM part
UNION ALL SELECT p_partkey * 10 + 2, 'ALTER TABLE t' || p_partkey || ' RENAME TO u' || p_partkey FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey * 10 + 3, 'ALTER TABLE ' || CASE WHEN p_partkey % 3 = 0 THEN 'u' ELSE 't' END || p_partkey || ' ADD COLUMN c DATE' FROM part
UNION ALL SELECT p_partkey * 10 + 4, 'ALTER TABLE ' || CASE WHEN p_partkey % 3 = 0 THEN 'u' ELSE 't' END || p_partkey || ' ALTER COLUMN a' || p_size || ' TYPE BIGINT' FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey * 10 + 5, 'ALTER TABLE ' || CASE WHEN p_partkey % 3 = 0 THEN 'u' ELSE 't' END || p_partkey || ' DROP COLUMN b' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey * 10 + 6, 'DROP TABLE ' || CASE WHEN p_partkey % 3 = 0 THEN 'u' ELSE 't' END || p_partkey FROM part WHERE p_partkey % 7 = 0"""


@query("""WITH t AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'u' ELSE 't' END || p_partkey AS "table", p_partkey AS k, p_size FROM part WHERE p_partkey % 7 <> 0)
SELECT "table", 'a' || p_size AS name, CASE WHEN k % 2 = 0 THEN 'BIGINT' ELSE 'INT' END AS type FROM t UNION ALL SELECT "table", 'b', 'VARCHAR(' || p_size || ')' FROM t WHERE k % 5 <> 0 UNION ALL SELECT "table", 'c', 'DATE' FROM t""")
def columns_with_pending(spark: SparkSession, d: str) -> DataFrame:
    """The columns that logs of statements leave."""
    none = spark.createDataFrame([], "table string, name string, type string")
    return schema_diff.with_pending(none, made(spark, d, LOG))


@query("SELECT DISTINCT 'SummingMergeTree((c' || p_size || ', b))' AS text, 'summing' AS kind, '(c' || p_size || ', b)' AS args FROM part WHERE p_size % 2 = 0 UNION ALL SELECT DISTINCT 'VersionedCollapsingMergeTree(sign, v' || p_size || ')', 'versioned_collapsing', 'sign|v' || p_size FROM part WHERE p_size % 2 = 1")
def parsed_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of table kinds, one for each size of parts."""
    told = made(spark, d, "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'SummingMergeTree((c' || p_size || ', b))' ELSE 'VersionedCollapsingMergeTree(sign, v' || p_size || ')' END AS text FROM part").collect()
    return spark.createDataFrame([(r.text, (k := TableKind.parse(r.text)).kind, "|".join(k.args)) for r in told], "text string, kind string, args string")


@query("SELECT DISTINCT 'SELECT ' || p_brand || ', ' || CASE WHEN p_size % 2 = 0 THEN 'sum(b)' ELSE 'b' END || ' FROM t' AS sql, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_type = 'SMALL' THEN 'ok' ELSE 'error' END ELSE CASE WHEN p_type = 'SMALL' THEN 'warning' ELSE 'ok' END END AS said FROM part")
def view_safety(spark: SparkSession, d: str) -> DataFrame:
    """Whether views of brands may write into tables that merge: those of small parts do."""
    told = made(spark, d, "SELECT DISTINCT 'SELECT ' || p_brand || ', ' || CASE WHEN p_size % 2 = 0 THEN 'sum(b)' ELSE 'b' END || ' FROM t' AS sql, CASE WHEN p_type = 'SMALL' THEN 'summing' ELSE 'merge_tree' END AS kind FROM part").collect()
    return spark.createDataFrame(sorted({(r.sql, select_is_safe(r.sql, r.kind)) for r in told}), "sql string, said string")
