"""Whole schemas as one relation of objects, and their difference by one full outer join.

An object is (kind, table, name, props): tables, columns, indexes, unique, check, exclude and foreign-key constraints, enums and views,
with their properties as text. Schemas of any number of tables are compared, ordered, judged and undone as rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.change_classes import enum_change_class, engine_change_class, option_change_class, type_change_class
from tidemark.functions.scalars import normal_default, normal_type
from tidemark.sources import places

OBJECTS = "kind string, table string, name string, props map<string,string>"
#: Kinds that are dropped and added again when anything of them changes.
REMADE = ("index", "check", "exclude", "view")
#: Properties of columns and tables that have an operation of their own, by kind.
ALTERED = {"column": ("type", "nullable", "default", "comment", "autoincrement"), "table": ("comment", "engine")}
#: What a foreign key does where it says nothing.
NO_ACTION = "NO ACTION"


def _list(text: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda c: F.trim(c))), ",")


def _of(name: str) -> Column:
    return F.try_element_at(F.col("props"), F.lit(name))


def identified(objects: DataFrame) -> DataFrame:
    """objects with id: what says that two are the same. Unique constraints are their columns in any order, foreign keys what they
    refer and do, all others their names."""
    action = lambda c: F.upper(F.coalesce(_of(c), F.lit(NO_ACTION)))
    reference = F.concat_ws("|", _list(_of("columns")), F.coalesce(_of("referenced_table"), F.lit("")), _list(_of("referenced_columns")), action("on_delete"), action("on_update"), F.coalesce(_of("deferrable"), F.lit("false")))
    return objects.withColumn("id", F.when(F.col("kind") == "foreign_key", reference).when(F.col("kind") == "unique", _list(_of("columns"))).otherwise(F.col("name")))


def object_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, kind, table, name, was, now, severity) that turns old objects into new.

    One full outer join; each pair tells its operations, which are written once, as what is told of whole tables hides some. Columns and indexes of tables that come or go
    as a whole aren't told, their constraints are. A unique constraint of the same columns under another name is renamed.
    An engine that changes makes the table anew; then nothing else of the table is told. Enums tell whether values go.
    """
    side = lambda df, c: identified(df).groupBy("kind", "table", "id").agg(F.min_by(F.struct("name", "props"), "name").alias(c))
    both = side(old, "a").join(side(new, "b"), ["kind", "table", "id"], "full")
    was, now = (lambda p: F.try_element_at(F.col("a.props"), F.lit(p))), (lambda p: F.try_element_at(F.col("b.props"), F.lit(p)))
    kept = F.col("a").isNotNull() & F.col("b").isNotNull()
    none = F.lit(None).cast("string")

    def op(when: Column, name: Column | str, a: Column = none, b: Column = none, grave: Column | str = "INFO", of: Column | None = None) -> Column:
        name, grave = (F.lit(x) if isinstance(x, str) else x for x in (name, grave))
        return F.when(when, F.struct(name.alias("op"), F.coalesce(of if of is not None else none, F.col("b.name"), F.col("a.name")).alias("name"), a.cast("string").alias("was"), b.cast("string").alias("now"), grave.alias("severity")))

    same = {"type": normal_type, "default": normal_default}
    form = lambda p, c: same.get(p, lambda x: x)(c)
    differs = lambda p: ~form(p, was(p)).eqNullSafe(form(p, now(p)))
    graves = {"type": type_change_class(was("type"), now("type")), "nullable": F.when(now("nullable") == "false", F.lit("WARN")).otherwise(F.lit("INFO")), "engine": F.when(engine_change_class(was("engine"), now("engine")) == "irreversible", F.lit("CRITICAL")).otherwise(F.lit("WARN"))}
    kind = F.col("kind")
    text = lambda side: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(f"{side}.props")))))
    grave_drop = F.when(kind.isin("table", "column", "view", "enum"), F.lit("CRITICAL")).otherwise(F.lit("WARN"))
    comes = F.concat(F.when(kind.isin("table", "view", "enum"), F.lit("create_")).otherwise(F.lit("add_")), kind)
    changed = kept & (text("a") != text("b"))
    ops = [
        op(F.col("a").isNull(), comes, b=text("b")),
        op(F.col("b").isNull(), F.concat(F.lit("drop_"), kind), a=text("a"), grave=grave_drop),
        *(op(kept & (kind == k) & differs(p), "recreate_table" if p == "engine" else f"alter_{k}_{p}", was(p), now(p), graves.get(p, "INFO")) for k, ps in ALTERED.items() for p in ps),
        op(changed & kind.isin(*REMADE), F.concat(F.lit("drop_"), kind), a=text("a"), grave="WARN"),
        op(changed & kind.isin(*REMADE), comes, b=text("b")),
        op(kept & (kind == "unique") & (F.col("a.name") != F.col("b.name")), "rename_unique", F.col("a.name"), F.col("b.name")),
        op(changed & (kind == "enum"), "alter_enum", was("values"), now("values"), enum_change_class(F.split(was("values"), ","), F.split(now("values"), ","))),
    ]
    options = F.when(kept & (kind == "table"), F.array_except(F.array_union(F.map_keys("a.props"), F.map_keys("b.props")), F.array(*map(F.lit, ALTERED["table"]))))
    each = F.transform(F.array_sort(F.coalesce(options, F.array().cast("array<string>"))), lambda o: F.struct(F.lit("alter_option").alias("op"), o.alias("name"), F.try_element_at(F.col("a.props"), o).alias("was"), F.try_element_at(F.col("b.props"), o).alias("now"), option_change_class(o).alias("severity")))
    told = both.select("kind", "table", F.explode(F.concat(F.filter(F.array(*ops), lambda o: o.isNotNull()), F.filter(each, lambda o: ~o["was"].eqNullSafe(o["now"])))).alias("o")).select("kind", "table", "o.*")
    told = places.kept(told, "told")
    # what is told of a table as a whole hides what is told of its parts
    whole = told.where("kind = 'table'").groupBy("table").agg(F.bool_or(F.col("op") == "recreate_table").alias("__anew"), F.bool_or(F.col("op").isin("create_table", "drop_table")).alias("__whole"))
    out = told.join(whole, "table", "left")
    hidden = F.coalesce(F.col("__whole"), F.lit(False)) & kind.isin("column", "index") | F.coalesce(F.col("__anew"), F.lit(False)) & ~F.col("op").isin("recreate_table", "create_table", "drop_table")
    return out.where(~hidden).select("op", "kind", "table", "name", "was", "now", "severity")


def undone(ops: DataFrame) -> DataFrame:
    """The operations that undo ops, where there are any: additions as drops and the other way round, changes with their sides changed."""
    name = F.col("op")
    back = F.regexp_replace(name, "^(create|add)_", "drop_")
    again = F.regexp_replace(name, "^drop_", "")
    again = F.concat(F.when(again.isin("table", "view", "enum"), F.lit("create_")).otherwise(F.lit("add_")), again)
    return ops.select(F.when(name.rlike("^(create|add)_"), back).when(name.startswith("drop_"), again).otherwise(name).alias("op"), "kind", "table", F.when(name == "rename_unique", F.col("was")).otherwise(F.col("name")).alias("name"), F.col("now").alias("was"), F.col("was").alias("now"))


def severities(ops: DataFrame, least: str | None = None) -> DataFrame:
    """(severity, op, n): a report of ops; with least, of that severity and graver."""
    order = F.array(*map(F.lit, ("SAFE", "INFO", "WARN", "CRITICAL")))
    kept = ops if least is None else ops.where(F.array_position(order, F.col("severity")) >= F.array_position(order, F.lit(least)))
    return kept.groupBy("severity", "op").agg(F.count("*").alias("n"))


def catalog_objects(spark: SparkSession, database: str | None = None, pattern: str = ".*") -> DataFrame:
    """Tables, views and columns of the session's catalog as objects, of those whose whole name matches. Names and types only are
    read, on the driver, table by table; a view that can't be resolved is an error."""
    rows = []
    for t in spark.catalog.listTables(database) if database else spark.catalog.listTables():
        if not re.fullmatch(pattern, t.name):
            continue
        kind = "view" if t.tableType in ("VIEW", "TEMPORARY") else "table"
        rows.append((kind, t.name, t.name, {"comment": t.description} if t.description else {}))
        name = t.name if t.isTemporary else ".".join([*(t.namespace or []), t.name])
        rows += [("column", t.name, f.name, {"type": f.dataType.simpleString(), "nullable": str(f.nullable).lower(), "position": str(i)} | ({"comment": c} if (c := f.getComment() if hasattr(f, "getComment") else (f.metadata or {}).get("comment")) else {})) for i, f in enumerate(spark.table(name).schema.fields)]
    return spark.createDataFrame(rows, OBJECTS)


def own_objects(objects: DataFrame, tables: list[str] | None = None, system: str = r"^(_tidemark_|tidemark_lock)") -> DataFrame:
    """objects without those of tables whose names match system; with tables, of these only."""
    kept = objects.where(~F.coalesce(F.col("table").rlike(system), F.lit(False)))
    return kept if tables is None else kept.where(F.col("table").isin(tables))


def irreversible(ops: DataFrame) -> DataFrame:
    """ops that can't be undone without losing rows: what drops tables or columns, and tables made anew with an engine that
    may merge rows away."""
    lossy = (F.col("op") == "recreate_table") & (engine_change_class(F.col("was"), F.col("now")) == "irreversible")
    return ops.where(F.col("op").isin("drop_table", "drop_column") | lossy)


def approved(ops: DataFrame, allowed: DataFrame) -> DataFrame:
    """ops, failing when one is read that can't be undone and isn't in allowed (op, table, name): the contract of a rollback."""
    bad = irreversible(ops).select("op", "table", "name").withColumn("__bad", F.lit(True)).distinct()
    bad = bad.join(allowed.select("op", "table", "name").distinct(), ["op", "table", "name"], "left_anti")
    return ops.join(bad, ["op", "table", "name"], "left").where(F.assert_true(F.col("__bad").isNull(), F.concat(F.col("op"), F.lit(" of "), F.col("table"), F.lit("."), F.col("name"), F.lit(" can't be undone and isn't allowed"))).isNull()).select(ops.columns)
