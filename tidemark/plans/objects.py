"""Queries over whole schemas: objects generated from the tables, thousands of them, compared, judged, undone and written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import change_classes as C
from tidemark.operators import ddl, dependencies, impact, objects, replay
from tidemark.plans.registry import query
from tidemark.plans.schemas import values
from tidemark.session import load

#: Generated schemas, as SQL that both engines run: a table for each ten parts, a column for each part, and constraints
#: for some of them; the new side lacks some, has others, and changes others.
SIDES = {
    "old": """
SELECT 'table' AS kind, 't' || p_partkey // 10 AS tab, 't' || p_partkey // 10 AS name, max(CASE WHEN p_partkey % 70 < 10 THEN 'x' END) AS comment, 'MergeTree' AS engine, max(CASE WHEN p_size > 25 THEN 'a' ELSE 'b' END) AS order_by, NULL AS type, NULL AS nullable, NULL AS dflt, NULL AS cols, NULL AS ref, NULL AS expr FROM part WHERE p_partkey // 10 % 9 <> 1 GROUP BY 2
UNION ALL SELECT 'column', 't' || p_partkey // 10, 'c' || p_partkey % 10, NULL, NULL, NULL, CASE WHEN p_size % 3 = 0 THEN 'varchar(' || p_size || ')' WHEN p_size % 3 = 1 THEN 'integer' ELSE 'timestamp' END, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, CASE WHEN p_size % 5 = 0 THEN '0' END, NULL, NULL, NULL FROM part WHERE p_partkey // 10 % 9 <> 1 AND p_partkey % 23 <> 0
UNION ALL SELECT 'index', 't' || p_partkey // 10, 'ix' || p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, 'c' || p_size % 4, NULL, NULL FROM part WHERE p_partkey // 10 % 9 <> 1 AND p_partkey % 10 = 3
UNION ALL SELECT 'unique', 't' || p_partkey // 10, 'uq' || p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, 'c1,c' || (2 + p_size % 3), NULL, NULL FROM part WHERE p_partkey // 10 % 9 <> 1 AND p_partkey % 10 = 4
UNION ALL SELECT 'check', 't' || p_partkey // 10, 'ck' || p_partkey % 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'c1 > ' || p_size FROM part WHERE p_partkey // 10 % 9 <> 1 AND p_partkey % 10 = 5
UNION ALL SELECT 'foreign_key', 't' || p_partkey // 10, 'fk' || p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, 'c1', 't' || p_size, NULL FROM part WHERE p_partkey // 10 % 9 <> 1 AND p_partkey % 10 = 6""",
    "new": """
SELECT 'table' AS kind, 't' || p_partkey // 10 AS tab, 't' || p_partkey // 10 AS name, max(CASE WHEN p_partkey % 50 < 10 THEN 'x' END) AS comment, max(CASE WHEN p_partkey // 10 % 11 = 0 THEN 'ReplacingMergeTree' ELSE 'MergeTree' END) AS engine, max(CASE WHEN p_size > 45 THEN 'a' ELSE 'b' END) AS order_by, NULL AS type, NULL AS nullable, NULL AS dflt, NULL AS cols, NULL AS ref, NULL AS expr FROM part WHERE p_partkey // 10 % 9 <> 2 GROUP BY 2
UNION ALL SELECT 'column', 't' || p_partkey // 10, 'c' || p_partkey % 10, NULL, NULL, NULL, CASE WHEN p_size % 3 = 0 THEN 'varchar(' || (p_size + p_partkey % 3 - 1) || ')' WHEN p_size % 3 = 1 THEN CASE WHEN p_partkey % 4 = 0 THEN 'bigint' ELSE 'int4' END ELSE CASE WHEN p_partkey % 4 = 0 THEN 'timestamptz' ELSE 'timestamp' END END, CASE WHEN p_size % 2 = 0 OR p_partkey % 3 = 0 THEN 'true' ELSE 'false' END, CASE WHEN p_size % 5 = 0 THEN '(' || p_partkey % 2 || ')' END, NULL, NULL, NULL FROM part WHERE p_partkey // 10 % 9 <> 2 AND p_partkey % 29 <> 0
UNION ALL SELECT 'index', 't' || p_partkey // 10, 'ix' || p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, 'c' || p_size % 6, NULL, NULL FROM part WHERE p_partkey // 10 % 9 <> 2 AND p_partkey % 10 = 3 AND p_partkey % 4 > 0
UNION ALL SELECT 'unique', 't' || p_partkey // 10, CASE WHEN p_size % 2 = 0 THEN 'un' ELSE 'uq' END || p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, 'c' || (2 + p_size % 4) || ',c1', NULL, NULL FROM part WHERE p_partkey // 10 % 9 <> 2 AND p_partkey % 10 = 4
UNION ALL SELECT 'check', 't' || p_partkey // 10, 'ck' || p_partkey % 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'c1 > ' || CASE WHEN p_size > 30 THEN 30 ELSE p_size END FROM part WHERE p_partkey // 10 % 9 <> 2 AND p_partkey % 10 = 5
UNION ALL SELECT 'foreign_key', 't' || p_partkey // 10, 'fk' || p_partkey % 10, NULL, NULL, NULL, NULL, NULL, NULL, 'c1', 't' || CASE WHEN p_size > 40 THEN 40 ELSE p_size END, NULL FROM part WHERE p_partkey // 10 % 9 <> 2 AND p_partkey % 10 = 6""",
}


def side(spark: SparkSession, d: str, which: str) -> DataFrame:
    """A generated schema as objects; properties that are null aren't there."""
    sql = SIDES[which].replace("FROM part ", "FROM {part} ").replace("p_partkey // 10", "p_partkey DIV 10")
    rows = spark.sql(sql, part=load(spark, d, "part"))
    of = {"comment": "comment", "engine": "engine", "order_by": "order_by", "type": "type", "nullable": "nullable", "default": "dflt", "columns": "cols", "referenced_table": "ref", "expression": "expr"}
    props = F.map_filter(F.create_map(*(x for k, c in of.items() for x in (F.lit(k), F.col(c)))), lambda k, v: v.isNotNull())
    return rows.select("kind", F.col("tab").alias("table"), "name", props.alias("props"))


NORMAL = "CASE t{0} WHEN 'int4' THEN 'integer' ELSE t{0} END"
#: The difference in SQL of its own: kind by kind, from joins of the two generated sides.
DIFF = f"""WITH o AS ({SIDES['old']}), w AS ({SIDES['new']}),
t AS (SELECT coalesce(o.tab, w.tab) AS tab, o.tab IS NULL AS made, w.tab IS NULL AS gone, coalesce(o.engine <> w.engine, false) AS anew, o.comment IS DISTINCT FROM w.comment AS said, o.order_by IS DISTINCT FROM w.order_by AS sorted
      FROM (SELECT * FROM o WHERE kind = 'table') o FULL JOIN (SELECT * FROM w WHERE kind = 'table') w ON o.tab = w.tab),
k AS (SELECT tab FROM t WHERE NOT made AND NOT gone AND NOT anew),
c AS (SELECT coalesce(o.tab, w.tab) AS tab, coalesce(o.name, w.name) AS name, o.tab IS NULL AS made, w.tab IS NULL AS gone, o.type AS t1, w.type AS t2, o.nullable AS n1, w.nullable AS n2, o.dflt AS d1, trim(w.dflt, '()') AS d2
      FROM (SELECT * FROM o WHERE kind = 'column') o FULL JOIN (SELECT * FROM w WHERE kind = 'column') w ON o.tab = w.tab AND o.name = w.name WHERE coalesce(o.tab, w.tab) IN (SELECT tab FROM k)),
i AS (SELECT coalesce(o.kind, w.kind) AS kind, coalesce(o.tab, w.tab) AS tab, coalesce(o.name, w.name) AS name, o.tab IS NULL AS made, w.tab IS NULL AS gone, (o.cols IS DISTINCT FROM w.cols OR o.expr IS DISTINCT FROM w.expr) AND o.tab IS NOT NULL AND w.tab IS NOT NULL AS other
      FROM (SELECT * FROM o WHERE kind IN ('index', 'check')) o FULL JOIN (SELECT * FROM w WHERE kind IN ('index', 'check')) w ON o.kind = w.kind AND o.tab = w.tab AND o.name = w.name
      WHERE coalesce(o.tab, w.tab) NOT IN (SELECT tab FROM t WHERE anew) AND (coalesce(o.kind, w.kind) = 'check' OR coalesce(o.tab, w.tab) IN (SELECT tab FROM k))),
u AS (SELECT kind, tab, name, CASE WHEN kind = 'unique' THEN list_aggregate(list_sort(string_split(cols, ',')), 'string_agg', ',') ELSE ref END AS id, 1 AS side FROM o WHERE kind IN ('unique', 'foreign_key')
      UNION ALL SELECT kind, tab, name, CASE WHEN kind = 'unique' THEN list_aggregate(list_sort(string_split(cols, ',')), 'string_agg', ',') ELSE ref END, 2 FROM w WHERE kind IN ('unique', 'foreign_key')),
v AS (SELECT kind, tab, id, min(name) FILTER (WHERE side = 1) AS a, min(name) FILTER (WHERE side = 2) AS b FROM u WHERE tab NOT IN (SELECT tab FROM t WHERE anew) GROUP BY ALL)
SELECT 'create_table' AS op, 'table' AS kind, tab AS "table", tab AS name, 'INFO' AS severity FROM t WHERE made
UNION ALL SELECT 'drop_table', 'table', tab, tab, 'CRITICAL' FROM t WHERE gone
UNION ALL SELECT 'recreate_table', 'table', tab, tab, 'CRITICAL' FROM t WHERE anew
UNION ALL SELECT 'alter_table_comment', 'table', tab, tab, 'INFO' FROM t WHERE tab IN (SELECT tab FROM k) AND said
UNION ALL SELECT 'alter_option', 'table', tab, 'order_by', 'CRITICAL' FROM t WHERE tab IN (SELECT tab FROM k) AND sorted
UNION ALL SELECT 'add_column', 'column', tab, name, 'INFO' FROM c WHERE made
UNION ALL SELECT 'drop_column', 'column', tab, name, 'CRITICAL' FROM c WHERE gone
UNION ALL SELECT 'alter_column_type', 'column', tab, name, CASE WHEN t2 LIKE 'varchar%' THEN CASE WHEN t1 LIKE 'varchar%' AND regexp_extract(t2, '[0-9]+')::INT >= regexp_extract(t1, '[0-9]+')::INT THEN 'SAFE' ELSE 'CRITICAL' END WHEN t2 = 'bigint' THEN 'SAFE' ELSE 'WARN' END FROM c WHERE NOT made AND NOT gone AND {NORMAL.format(1)} <> {NORMAL.format(2)}
UNION ALL SELECT 'alter_column_nullable', 'column', tab, name, CASE WHEN n2 = 'false' THEN 'WARN' ELSE 'INFO' END FROM c WHERE NOT made AND NOT gone AND n1 <> n2
UNION ALL SELECT 'alter_column_default', 'column', tab, name, 'INFO' FROM c WHERE NOT made AND NOT gone AND d1 IS DISTINCT FROM d2
UNION ALL SELECT 'add_' || kind, kind, tab, name, 'INFO' FROM i WHERE made OR other
UNION ALL SELECT 'drop_' || kind, kind, tab, name, 'WARN' FROM i WHERE gone OR other
UNION ALL SELECT 'add_' || kind, kind, tab, b, 'INFO' FROM v WHERE a IS NULL
UNION ALL SELECT 'drop_' || kind, kind, tab, a, 'WARN' FROM v WHERE b IS NULL
UNION ALL SELECT 'rename_unique', kind, tab, b, 'INFO' FROM v WHERE kind = 'unique' AND a <> b"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    return objects.object_diff(side(spark, d, "old"), side(spark, d, "new"))


@query(DIFF)
def object_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two generated schemas: a table for each ten parts, with columns, indexes and constraints."""
    return changes(spark, d).select("op", "kind", "table", "name", "severity")


@query("SELECT 0 AS n")
def objects_converge(spark: SparkSession, d: str) -> DataFrame:
    """A schema held against itself has no operations."""
    return objects.object_diff(side(spark, d, "new"), side(spark, d, "new")).agg(F.count("*").alias("n"))


@query(f"SELECT severity, op, count(*) AS n FROM ({DIFF}) WHERE severity IN ('WARN', 'CRITICAL') GROUP BY ALL")
def severity_report(spark: SparkSession, d: str) -> DataFrame:
    return objects.severities(changes(spark, d), "WARN")


@query("SELECT 0 AS n")
def undone_is_the_difference_back(spark: SparkSession, d: str) -> DataFrame:
    """What undoes the operations of one direction is the operations of the other, but for what is told of whole tables."""
    there, back = objects.undone(changes(spark, d)), objects.object_diff(side(spark, d, "new"), side(spark, d, "old")).select("op", "kind", "table", "name", "was", "now")
    return there.exceptAll(back).unionByName(back.exceptAll(there)).agg(F.count("*").alias("n"))


@query(f"""WITH o AS ({SIDES['old']}), p AS (
SELECT tab, 0 AS late, name, name || ' ' || upper(type) || CASE WHEN nullable = 'false' THEN ' NOT NULL' ELSE '' END || coalesce(' DEFAULT ' || dflt, '') AS part FROM o WHERE kind = 'column'
UNION ALL SELECT tab, 1, name, 'CONSTRAINT ' || name || ' UNIQUE (' || cols || ')' FROM o WHERE kind = 'unique'
UNION ALL SELECT tab, 1, name, 'CONSTRAINT ' || name || ' CHECK (' || expr || ')' FROM o WHERE kind = 'check'
UNION ALL SELECT tab, 1, name, 'CONSTRAINT ' || name || ' FOREIGN KEY (' || cols || ') REFERENCES ' || ref FROM o WHERE kind = 'foreign_key')
SELECT tab AS "table", 'CREATE TABLE ' || tab || ' (' || string_agg(part, ', ' ORDER BY late, name) || ')' AS sql FROM p GROUP BY tab""")
def table_definitions(spark: SparkSession, d: str) -> DataFrame:
    return ddl.definitions(side(spark, d, "old"))


@query(f"""WITH {DIFF[5:]}""".replace("SELECT 'create_table' AS op", "SELECT op, \"table\", name, CASE WHEN op = 'drop_table' THEN 'DROP TABLE ' || \"table\" WHEN op = 'drop_column' THEN 'ALTER TABLE ' || \"table\" || ' DROP COLUMN ' || name WHEN op = 'drop_index' THEN 'DROP INDEX ' || name ELSE 'ALTER TABLE ' || \"table\" || ' DROP CONSTRAINT ' || name END AS sql FROM (SELECT 'create_table' AS op", 1) + ") WHERE op LIKE 'drop%'")
def drop_statements(spark: SparkSession, d: str) -> DataFrame:
    """What drops in the difference of two generated schemas, as statements."""
    return ddl.statements(changes(spark, d), side(spark, d, "old"), side(spark, d, "new")).where("op LIKE 'drop%'").join(tables_made_anew(spark, d), "table", "left_anti").select("op", "table", "name", "sql")


def tables_made_anew(spark: SparkSession, d: str) -> DataFrame:
    return changes(spark, d).where("op = 'recreate_table'").select("table")


#: What the generated schemas hold that statements make, by place.
HELD = "SELECT tab AS \"table\", CASE WHEN kind IN ('unique', 'check', 'foreign_key') THEN 'constraint' ELSE kind END AS kind, CASE WHEN kind <> 'foreign_key' THEN name END AS name, {0} AS type FROM w WHERE kind <> 'table'"
TYPED = "CASE kind WHEN 'column' THEN CASE type WHEN 'int4' THEN 'integer' ELSE type END WHEN 'index' THEN '(' || cols || ')' WHEN 'unique' THEN 'UNIQUE (' || cols || ')' WHEN 'check' THEN 'CHECK (' || expr || ')' ELSE 'FOREIGN KEY (' || cols || ') REFERENCES ' || ref END"


@query(f"WITH w AS ({SIDES['new']}) {HELD.format(TYPED)} AND kind <> 'unique' UNION ALL {HELD.format('NULL')} AND kind = 'unique'")
def migrated_schema(spark: SparkSession, d: str) -> DataFrame:
    """The old schema once the difference's statements have been replayed on it, in their order: the new one. A unique constraint
    that was only renamed lists its columns as the old one did, so their text isn't told; foreign keys are what they refer to."""
    old, new = side(spark, d, "old"), side(spark, d, "new")
    sql = ddl.statements(objects.object_diff(old, new), old, new).where("op NOT IN ('alter_table_comment', 'alter_option')").select("seq", "sql")
    held = old.where("kind <> 'table'").select("table", F.when(F.col("kind").isin("unique", "check", "foreign_key"), F.lit("constraint")).otherwise(F.col("kind")).alias("kind"), "name", F.coalesce(F.col("props.type"), ddl.definition(lambda p: F.try_element_at("props", F.lit(p)), F.col("kind"), F.col("table"), F.col("name"))).alias("type"))
    told = F.regexp_replace(F.regexp_replace("type", r"^CONSTRAINT \w+ ", ""), r"^INDEX \w+ ON \w+ ", "")
    out = replay.replayed(held, sql).where(~F.col("table").endswith("__old")).withColumn("type", told)
    typed = F.when(F.col("kind") == "column", F.regexp_replace(F.lower("type"), "^int4$", "integer")).when(~F.col("type").startswith("UNIQUE"), F.col("type"))
    return out.select("table", "kind", F.when(~F.col("type").startswith("FOREIGN KEY"), F.col("name")).alias("name"), typed.alias("type"))


#: The generated schema's graph in SQL of its own; tables refer to tables, so it may have cycles: those are left out by level.
GRAPH = f"""WITH RECURSIVE w AS ({SIDES['new']}), n AS (SELECT kind || '|' || tab || '|' || name AS id, kind, tab, name, cols, ref FROM w),
e AS (SELECT id, 'table|' || tab || '|' || tab AS need FROM n WHERE kind <> 'table' UNION SELECT id, 'column|' || tab || '|' || trim(unnest(string_split(cols, ','))) FROM n WHERE cols IS NOT NULL UNION SELECT id, 'table|' || ref || '|' || ref FROM n WHERE kind = 'foreign_key'),
k AS (SELECT e.id, e.need FROM e JOIN n ON e.need = n.id),
l AS (SELECT id, 0 AS level FROM n WHERE id NOT IN (SELECT id FROM k) UNION SELECT k.id, l.level + 1 FROM l JOIN k ON k.need = l.id)
SELECT id, max(level) AS level FROM l GROUP BY id"""


@query(GRAPH)
def object_levels(spark: SparkSession, d: str) -> DataFrame:
    """How deep each object of a generated schema lies in what it depends on."""
    return dependencies.object_levels(side(spark, d, "new"))


@query(f"""WITH {DIFF[5:]}""".replace("SELECT 'create_table' AS op", "SELECT op, \"table\", name FROM (SELECT 'create_table' AS op", 1) + ") WHERE op IN ('drop_table', 'drop_column', 'recreate_table')")
def irreversible_operations(spark: SparkSession, d: str) -> DataFrame:
    return objects.irreversible(changes(spark, d)).select("op", "table", "name")


ENUMS = [(["a", "b"], ["a", "b"], "SAFE"), (["a", "b"], ["b", "a"], "SAFE"), (["a"], ["a", "c"], "WARN"), (["a", "b"], ["a"], "CRITICAL"), (["a", "b"], ["b", "c"], "CRITICAL"), (["a"], ["z"], "CRITICAL")]


@query(f"SELECT a, b, CASE WHEN NOT list_has_all(b, a) THEN 'CRITICAL' WHEN NOT list_has_all(a, b) THEN 'WARN' ELSE 'SAFE' END AS class FROM {values(ENUMS, 'a, b, c')}")
def enum_change_classes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([e[:2] for e in ENUMS], "a array<string>, b array<string>").withColumn("class", C.enum_change_class(F.col("a"), F.col("b")))


OPTIONS = ["engine_raw", "order_by", "object_type", "select_statement", "to_table", "dictionary", "settings", "zookeeper_path", "replica_name", "dict_layout", "dict_source", "dict_lifetime", "dict_primary_key", "ttl", "partition_by", "sample_by"]


@query(f"SELECT name, CASE WHEN name IN ('engine_raw', 'order_by', 'object_type', 'select_statement', 'to_table', 'dictionary') THEN 'CRITICAL' WHEN name = 'settings' OR name LIKE 'dict%' OR name LIKE '%\\_path' ESCAPE '\\' OR name LIKE 'replica%' THEN 'WARN' ELSE 'INFO' END AS class FROM {values([(o,) for o in OPTIONS], 'name')}")
def ch_option_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of options of column-store tables."""
    return spark.createDataFrame([(o,) for o in OPTIONS], "name string").withColumn("class", C.option_change_class(F.col("name")))


PROPERTIES = [("type", "Int32", "Int64", "WARN"), ("type", "AggregateFunction(sum, Float64)", "Float64", "CRITICAL"), ("type", "Int8", "AggregateFunction(count)", "CRITICAL"), ("low_cardinality", "false", "true", "CRITICAL"), ("nullable", "true", "false", "CRITICAL"), ("codec", None, "ZSTD(3)", "WARN"), ("ttl", "a", "b", "WARN"), ("alias", None, "x", "WARN"), ("comment", "a", "b", "INFO")]


@query(f"SELECT name, a, b, class FROM {values(PROPERTIES, 'name, a, b, class')}")
def ch_column_classes(spark: SparkSession, d: str) -> DataFrame:
    """Of properties of column-store columns."""
    return spark.createDataFrame([p[:3] for p in PROPERTIES], "name string, a string, b string").withColumn("class", C.property_change_class(F.col("name"), F.col("a"), F.col("b")))


ENGINES = ["MergeTree", "ReplacingMergeTree(ver)", "SummingMergeTree", "ReplicatedMergeTree('/p', 'r')", "ReplicatedSummingMergeTree('/p', 'r')", "Memory", "Log", "TinyLog", "Kafka", "CollapsingMergeTree(sign)"]


@query(f"""WITH e AS (SELECT t, lower(string_split(t, '(')[1]) AS f FROM {values([(e,) for e in ENGINES], 't')})
SELECT a.t AS old, b.t AS "new", CASE WHEN a.f IN ('mergetree', 'replicatedmergetree', 'memory', 'log', 'tinylog') AND b.f IN ('mergetree', 'replicatedmergetree', 'memory', 'log', 'tinylog') THEN 'conditional' ELSE 'irreversible' END AS rollback FROM e a, e b""")
def engine_changes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a table made anew with another engine can be made back."""
    names = F.array(*map(F.lit, ENGINES))
    pairs = spark.range(1).select(F.explode(names).alias("old"), names.alias("n")).select("old", F.explode("n").alias("new"))
    return pairs.withColumn("rollback", C.engine_change_class(F.col("old"), F.col("new")))


#: Names looked for: the words of parts' names, their first three letters, and types.
NAMES = "SELECT DISTINCT lower(w) AS target FROM (SELECT {0} AS w FROM part UNION ALL SELECT substr({0}, 1, 3) FROM part UNION ALL SELECT p_type FROM part)"


@query(f"""WITH n AS ({NAMES.format("unnest(string_split(p_name, ' '))").replace("substr(unnest(string_split(p_name, ' ')), 1, 3) FROM part", "substr(w, 1, 3) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")}),
l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT file, line::INTEGER AS line, target, (strpos(lower(text), target) - 1)::INTEGER AS at FROM l JOIN n ON contains(lower(text), target) WHERE trim(text) <> '' AND NOT regexp_matches(ltrim(text), '^(#|//|--|\"{{3}}|''{{3}})')""")
def names_in_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents that hold names of parts."""
    parts = load(spark, d, "part")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("target"))
    targets = words.union(words.select(F.substring("target", 1, 3))).union(parts.select("p_type"))
    return impact.contained(impact.lines_of(load(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("source"))), targets)
