"""What depends on what: levels of a dependency graph, the graph of a schema's objects, and operations in an order that works.

Levels are found by shortening ways instead of walking them: a node that needs one other only is passed over, and whoever
needs it needs that other one, further away; nodes that need the same ones are one. So long chains, and diamonds however many are in a row, take a number of rounds
that grows with the logarithm of their length. Each round is a join and a grouping of the needs that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.places import kept

#: The order of operations, kinds of steps first. What goes and is in the way of others goes first, then come new
#: things and changes, then what hangs on them, and at last what nothing hangs on any more.
STEPS = {
    "clear": ("drop_view", "drop_foreign_key", "drop_check", "drop_exclude", "drop_unique", "drop_index", "rename_unique"),
    "make": ("create_enum", "alter_enum", "create_table", "recreate_table", "add_column"),
    "change": ("alter_column_type", "alter_column_nullable", "alter_column_default", "alter_column_autoincrement"),
    "attach": ("add_index", "add_unique", "add_check", "add_exclude", "add_foreign_key", "create_view"),
    "remove": ("drop_column", "drop_table", "drop_enum"),
    "tell": ("alter_table_comment", "alter_column_comment", "alter_option", "alter_table_engine"),
}


def dependency_levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, level) of all nodes (id), by needs (id, need): 0 for those that need nothing, else one above the highest that they need.

    Nodes in a cycle, that need one that isn't there, or that need such a node have no level: theirs is null. Null and repeated
    ids and needs say nothing.
    """
    nodes = kept(nodes.where("id IS NOT NULL").select("id").distinct(), "nodes")
    needs = needs.where("id IS NOT NULL AND need IS NOT NULL").select("id", "need").distinct()
    # the way down from a node to one that it needs, and its length; to null: to the ground, below which is nothing
    bare = nodes.join(needs, "id", "left_anti").select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("need"), F.lit(0).alias("far"))
    ways = kept(nodes.join(needs, "id").select("id", "need", F.lit(1).alias("far")).unionByName(bare), "ways")
    total, grounded = nodes.count(), -1
    while True:
        # nodes of the same needs, equally far, are of one level: one of them stands for all
        said = [F.bit_xor(F.xxhash64(F.lit(salt), "need", "far")).alias(f"said{salt}") for salt in (1, 2)]
        summed = kept(ways.groupBy("id").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("far").alias("far"), *said), "summed")
        done = summed.where("n = 1 AND need IS NULL").count()  # a node has one way to the ground at most
        if done in (total, grounded):
            break
        grounded = done
        alike = summed.where("n > 1").groupBy("n", "said1", "said2").agg(F.min("id").alias("one"), F.count("*").alias("of")).where("of > 1")
        onwards = summed.where("n = 1").select("id", F.col("need").alias("then"), F.col("far").alias("more"))
        onwards = onwards.unionByName(summed.join(alike, ["n", "said1", "said2"]).where("id <> one").select("id", F.col("one").alias("then"), F.lit(0).alias("more")))
        passed = ways.join(onwards.select(F.col("id").alias("need"), F.lit(True).alias("over"), "then", "more"), "need", "left")
        # a way that comes back to where it began is a cycle, and stays as it is
        over = F.coalesce(F.col("over"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("then"))
        shorter = passed.select("id", F.when(over, F.col("then")).otherwise(F.col("need")).alias("need"), F.when(over, F.col("far") + F.col("more")).otherwise(F.col("far")).alias("far"))
        ways = kept(shorter.groupBy("id", "need").agg(F.max("far").alias("far")), "ways")
    levels = ways.groupBy("id").agg(F.count("need").alias("open"), F.max("far").alias("far"))
    return levels.select("id", F.when(F.col("open") == 0, F.col("far")).cast("int").alias("level"))


def numbered(rows: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """rows with their number in an order, from 1. They are sorted in ranges; a range's first number is how many rows come before it."""
    at = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "numbered")
    before = at.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("first"))
    before = before.select("__part", (F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first") + 1).alias("__more"))
    return at.join(F.broadcast(before), "__part").withColumn(name, F.col("__row") + F.col("__more")).drop("__part", "__row", "__more")


def object_key(kind: Column | str, table: Column | str, name: Column | str) -> Column:
    """An object's place in the graph, as text. Enums are of no table."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws("|", kind, F.when(kind != "enum", table).otherwise(F.lit("")), name)


def object_needs(objects: DataFrame) -> DataFrame:
    """(id, need) of objects (kind, table, name, props) by their places: columns need their table and enum; indexes and constraints their
    table and columns; foreign keys also the table, columns and unique constraint that they refer to; views the tables and views
    that they name. Each comes from one join or from the object itself."""
    p = lambda c: F.try_element_at(F.col("props"), F.lit(c))
    kind, table, name = F.col("kind"), F.col("table"), F.col("name")
    cut = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    sorted_list = lambda c: F.array_join(F.array_sort(cut(c)), ",")
    on_columns = lambda t, c: F.transform(cut(c), lambda x: object_key("column", t, x))
    own = F.when(kind == "column", F.array(object_key("table", table, table), object_key("enum", table, p("type")))).when(
        kind.isin("index", "unique", "check", "exclude", "foreign_key"),
        F.concat(F.array(object_key("table", table, table)), on_columns(table, p("columns")), F.when(kind == "foreign_key", F.concat(F.array(object_key("table", p("referenced_table"), p("referenced_table"))), on_columns(p("referenced_table"), p("referenced_columns")))).otherwise(F.array().cast("array<string>"))),
    )
    me = object_key(kind, table, name)
    listed = objects.select(me.alias("id"), F.explode(own).alias("need"))
    there = objects.select(me.alias("need")).distinct()
    keys = objects.where("kind = 'foreign_key'").select(me.alias("id"), p("referenced_table").alias("of"), sorted_list(p("referenced_columns")).alias("by"))
    uniques = objects.where("kind = 'unique'").select(me.alias("need"), table.alias("of"), sorted_list(p("columns")).alias("by"))
    words = objects.where("kind = 'view'").select(me.alias("id"), name.alias("self"), F.explode(F.array_distinct(F.regexp_extract_all(p("select"), F.lit(r'[A-Za-z_][A-Za-z0-9_]*'), F.lit(0)))).alias("word"))
    named = objects.where("kind IN ('table', 'view')").select(me.alias("need"), name.alias("word"))
    out = listed.join(there, "need").select("id", "need").unionByName(keys.join(uniques, ["of", "by"]).select("id", "need"))
    return out.unionByName(words.join(named, "word").where("word <> self").select("id", "need")).where("id <> need").distinct()


def object_levels(objects: DataFrame) -> DataFrame:
    """(id, level) of a schema's objects; see dependency_levels()."""
    return dependency_levels(objects.select(object_key(F.col("kind"), F.col("table"), F.col("name")).alias("id")), object_needs(objects))


def in_order(ops: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """ops (op, kind, table, name, …) with level and seq, the order in which they can be applied: by their step, and in it by what depends
    on what, in the old schema for what goes (dependents first) and in the new one for what comes. level is null for objects in a
    cycle or that need what isn't there; they come last in their step, where the caller can see them."""
    spots = [(s, op) for s, of in enumerate(STEPS.values()) for op in of]
    step = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for s, op in spots for x in (op, s))), F.col("op")), F.lit(len(STEPS)))
    goes = F.col("op").startswith("drop_")
    id_ = object_key(F.col("kind"), F.col("table"), F.when(F.col("op") == "alter_option", F.col("table")).otherwise(F.col("name")))
    levels = object_levels(old).withColumn("goes", F.lit(True)).unionByName(object_levels(new).withColumn("goes", F.lit(False)))
    placed = ops.withColumns({"goes": goes, "id": id_, "step": step}).join(levels, ["goes", "id"], "left")
    order = [F.col("step"), F.when(F.col("goes"), -F.col("level")).otherwise(F.col("level")).asc_nulls_last(), F.col("op"), F.col("table"), F.col("name")]
    return numbered(placed, order).drop("goes", "id", "step")
