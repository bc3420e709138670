"""Schema differences as joins of catalog relations.

A schema is two relations: columns (table, name, position, type, nullable, default) and tables (table, kind, options).
Differences are rows of (op, table, name, detail), so they are ordered, filtered and counted like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.change_classes import type_change_class
from tidemark.functions.scalars import normal_default, normal_statement, normal_type
from tidemark.operators.dependencies import dependency_levels
from tidemark.operators.replay import replayed
from tidemark.sources.places import kept

COLUMNS = "table string, name string, position int, type string, nullable boolean, default string"
#: Tables are taken for renamed from this share of common columns.
OVERLAP = 0.6
#: Kinds of operations in the order in which they can be applied.
OP_ORDER = (
    "create_schema", "create_table", "rename_table", "add_column", "rename_column", "alter_column_type", "alter_column_nullable",
    "alter_column_default", "alter_column_comment", "add_index", "add_unique_constraint", "add_check_constraint", "add_foreign_key",
    "drop_foreign_key", "drop_check_constraint", "drop_unique_constraint", "drop_index", "drop_column", "drop_table", "drop_schema",
)


def columns_of(frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """The columns relation of DataFrames by table name."""
    rows = [(t, f.name, i, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("default")) for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, COLUMNS)


def canonical(columns: DataFrame) -> DataFrame:
    """columns with types and defaults in the form in which they are compared."""
    return columns.withColumns({"type": normal_type(F.col("type")), "default": normal_default(F.col("default"))})


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, table, name, detail) that turns old columns into new. One full outer join and one grouping by table; columns of
    tables that are created or dropped as a whole aren't told."""
    side = lambda df, c: canonical(df).select("table", "name", F.struct("type", "nullable", "default").alias(c))
    both = side(old, "a").join(side(new, "b"), ["table", "name"], "full_outer")
    tables = both.groupBy("table").agg(F.count("a").alias("was"), F.count("b").alias("is"), F.collect_list(F.struct("name", "a", "b")).alias("columns"))
    none = F.lit(None).cast("string")
    op = lambda name, of=none, detail=none: F.struct((F.lit(name) if isinstance(name, str) else name).alias("op"), of.alias("name"), detail.alias("detail"))

    def told(c: Column) -> Column:
        a, b = c["a"], c["b"]
        text = lambda x, f: F.coalesce(x[f].cast("string"), F.lit("null"))
        changes = [F.when(~a[f].eqNullSafe(b[f]), op(f"alter_column_{f}", c["name"], F.concat_ws(" -> ", text(a, f), text(b, f)))) for f in ("type", "nullable", "default")]
        one = F.array(F.when(a.isNull(), op("add_column", c["name"], b["type"])).otherwise(op("drop_column", c["name"], a["type"])))
        return F.when(a.isNull() | b.isNull(), one).otherwise(F.filter(F.array(*changes), lambda x: x.isNotNull()))

    ops = F.when(F.col("was") == 0, F.array(op("create_table"))).when(F.col("is") == 0, F.array(op("drop_table"))).otherwise(F.flatten(F.transform("columns", told)))
    return tables.select("table", F.explode(ops).alias("o")).select("o.op", "table", "o.name", "o.detail")


def rename_candidates(ops: DataFrame) -> DataFrame:
    """(table, old, new, type) of dropped and added columns that may be one. In each table and type: as many dropped as
    added are paired in the order of their names; otherwise there are none."""
    in_type = Window.partitionBy("table", "detail")
    side = lambda op, name: ops.where(F.col("op") == op).select("table", "detail", F.col("name").alias(name), F.row_number().over(in_type.orderBy("name")).alias("k"), F.count("*").over(in_type).alias(f"n_{name}"))
    return side("drop_column", "old").join(side("add_column", "new"), ["table", "detail", "k"]).where("n_old = n_new").select("table", "old", "new", F.col("detail").alias("type"))


def with_renames(ops: DataFrame, confirmed: DataFrame) -> DataFrame:
    """ops with confirmed (table, old, new) as rename_column in place of a drop and an add."""
    dropped = confirmed.select("table", F.col("old").alias("name"))
    added = confirmed.select("table", F.col("new").alias("name"))
    left = ops.join(dropped.withColumn("op", F.lit("drop_column")), ["op", "table", "name"], "left_anti").join(added.withColumn("op", F.lit("add_column")), ["op", "table", "name"], "left_anti")
    return left.unionByName(confirmed.select(F.lit("rename_column").alias("op"), "table", F.col("old").alias("name"), F.col("new").alias("detail")))


def table_overlap(old: DataFrame, new: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(old_table, new_table, score) of dropped and created tables: columns alike in name and type, over the larger count.
    Tables of the same columns are one class. Pairs of classes come from the columns they share, so those with nothing in common are
    never tried; only pairs that reach least are told for all their tables."""
    old, new = canonical(old), canonical(new)
    gone = _alike(old.join(new.select("table").distinct(), "table", "left_anti"), "old")
    come = _alike(new.join(old.select("table").distinct(), "table", "left_anti"), "new")
    side = lambda df, as_: df.groupBy(f"{as_}_columns").agg(F.min(f"{as_}_table").alias(as_)).select(as_, F.size(f"{as_}_columns").alias(f"n_{as_}"), F.explode(f"{as_}_columns").alias("c")).select(as_, f"n_{as_}", "c.*")
    shared = side(gone, "old").join(side(come, "new"), ["name", "type"]).groupBy("old", "new", "n_old", "n_new").agg(F.count("*").alias("common"))
    scored = shared.withColumn("score", F.col("common") / F.greatest("n_old", "n_new")).where(F.col("score") >= least).select("old", "new", "score")
    # each table with the first of its class, by which the pairs are spread
    first = lambda df, as_: df.join(df.groupBy(f"{as_}_columns").agg(F.min(f"{as_}_table").alias(as_)), f"{as_}_columns").select(as_, f"{as_}_table")
    return scored.join(first(gone, "old"), "old").join(first(come, "new"), "new").select("old_table", "new_table", "score")


def _alike(columns: DataFrame, as_: str) -> DataFrame:
    """(table, columns) of tables that have a name: what tells those of the same columns, in any order, is one array."""
    all_of = F.array_sort(F.collect_list(F.struct("name", "type"))).alias(f"{as_}_columns")
    return kept(columns.where("table IS NOT NULL").groupBy(F.col("table").alias(f"{as_}_table")).agg(all_of), "tables")


def ordered(ops: DataFrame, rollback: bool = False) -> DataFrame:
    """ops with seq, in the order of their kinds, tables and names; reversed for a rollback."""
    place = F.array_position(F.array(*map(F.lit, OP_ORDER)), F.col("op"))
    keys = [F.when(place == 0, len(OP_ORDER) + 1).otherwise(place), F.col("table"), F.col("name")]
    order = [k.desc() if rollback else k.asc() for k in keys]
    return ops.withColumn("seq", F.row_number().over(Window.orderBy(*order)))  # a few rows: operations of one migration


def classify_type_change(old: Column, new: Column) -> Column:
    """SAFE, WARN or CRITICAL; see type_change_class()."""
    return type_change_class(old, new)


def severity(ops: DataFrame) -> DataFrame:
    """ops with severity: what a migration may lose."""
    split = F.split("detail", " -> ")
    return ops.withColumn(
        "severity",
        F.when(F.col("op").isin("drop_table", "drop_column", "drop_schema"), F.lit("CRITICAL"))
        .when(F.col("op") == "alter_column_type", classify_type_change(split[0], split[1]))
        .when((F.col("op") == "alter_column_nullable") & (split[1] == "false"), F.lit("WARN"))
        .when(F.col("op").startswith("rename"), F.lit("WARN"))
        .otherwise(F.lit("SAFE")),
    )


def immutable_changes(old: DataFrame, new: DataFrame, fields: list[str], key: str = "table") -> DataFrame:
    """(table, field, old, new) of options that can't change on a table that exists."""
    pair = old.select(key, *(F.col(f).alias(f"__a_{f}") for f in fields)).join(new.select(key, *(F.col(f).alias(f"__b_{f}") for f in fields)), key)
    told = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"__a_{f}").cast("string").alias("old"), F.col(f"__b_{f}").cast("string").alias("new")) for f in fields)))
    return pair.select(key, told.alias("c")).select(key, "c.*").where("NOT (old <=> new)")


def key_only_grows(old: Column, new: Column) -> Column:
    """Whether a sort key only had columns appended."""
    return F.slice(new, 1, F.size(old)) == old


def without_default_settings(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """settings (table, name, value) that differ from defaults (name, value)."""
    return settings.join(defaults, ["name", "value"], "left_anti").select("table", "name", "value")


def primary_key_or_null(spec: DataFrame) -> DataFrame:
    """spec with primary_key null where it says no more than order_by."""
    return spec.withColumn("primary_key", F.when(~F.col("primary_key").eqNullSafe(F.col("order_by")), F.col("primary_key")))


def same_indexes(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(table, name, change): added, dropped or changed indexes, compared by all fields at once."""
    a = old.select("table", "name", F.struct(*fields).alias("a"))
    b = new.select("table", "name", F.struct(*fields).alias("b"))
    change = F.when(F.col("a").isNull(), "add_index").when(F.col("b").isNull(), "drop_index").when(~F.col("a").eqNullSafe(F.col("b")), "recreate_index")
    return a.join(b, ["table", "name"], "full_outer").select("table", "name", change.alias("change")).where("change IS NOT NULL")


def constraint_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, table, name, columns) of constraints (table, name, columns): those with the same columns and another name
    are renamed; the order of columns says nothing."""
    key = lambda df: df.withColumn("columns", F.array_sort("columns"))
    a, b = key(old), key(new)
    both = a.select("table", "columns", F.col("name").alias("was")).join(b.select("table", "columns", F.col("name").alias("is")), ["table", "columns"], "full_outer")
    change = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "drop").when(F.col("was") != F.col("is"), "rename")
    return both.select(change.alias("change"), "table", F.coalesce("is", "was").alias("name"), F.array_join("columns", ",").alias("columns")).where("change IS NOT NULL")


def enum_diff(old: Column, new: Column) -> Column:
    """struct(added, removed) of two lists of an enum's values."""
    return F.struct(F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed"))


def fresh_statements(statements: DataFrame, known: DataFrame) -> DataFrame:
    """Statements (sql) that aren't among known ones but for case and white space."""
    return statements.withColumn("__n", normal_statement(F.col("sql"))).join(known.select(normal_statement(F.col("sql")).alias("__n")), "__n", "left_anti").drop("__n")


def plan(ops: DataFrame) -> DataFrame:
    """(plan, checksum): the operations as JSON in order, and the digest of it."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "op", "table", "name", "severity")))
    body = F.to_json(F.transform(rows, lambda r: r.dropFields("seq")))
    return severity(ordered(ops)).agg(body.alias("plan")).withColumn("checksum", F.sha2("plan", 256))


def dependency_order(files: DataFrame, complete: bool = False) -> DataFrame:
    """(version, level) of migrations (version, depends_on array): each after all those it depends on, however long the way.

    Versions in a cycle, that need one that isn't there, or that need such a version, have no level and aren't returned; with
    complete, they are an error that names some of them.
    """
    nodes = files.select(F.col("version").alias("id"))
    needs = files.select(F.col("version").alias("id"), F.explode("depends_on").alias("need"))
    levels = dependency_levels(nodes, needs)
    left = [str(r.id) for r in levels.where("level IS NULL").orderBy("id").limit(20).collect()] if complete else []
    if left:
        raise ValueError(f"versions that can't be ordered: {', '.join(left)}")
    return levels.where("level IS NOT NULL").select(F.col("id").alias("version"), "level")


def with_pending(columns: DataFrame, statements: DataFrame) -> DataFrame:
    """columns (table, name, type) as they will be once statements (seq, sql) have run; see replayed()."""
    return replayed(columns, statements).where("kind = 'column'").select("table", "name", "type")
