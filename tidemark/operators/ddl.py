"""The difference of two schemas as SQL statements, in an order in which they can be applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dependencies import in_order
from tidemark.sources.places import kept

#: Words that can't be names without quotes.
RESERVED = (
    "all and any array as asc between both by case cast check collate column constraint create cross current_date current_time current_timestamp "
    "default desc distinct do else end except exists false fetch for foreign from full grant group having in index inner intersect into is join lateral leading left "
    "like limit natural not null offset on only or order outer primary references right select session_user some table then to trailing true union unique user using view when where window with"
).split()


def quoted(name: Column) -> Column:
    """A name as it stands in a statement: as it is if it is plain, else in double quotes. Expressions, which have parentheses or
    quotes, stay."""
    plain = name.rlike(r"^[a-z_][a-z0-9_$]*$") & ~name.isin(*RESERVED) | name.rlike(r"[()\"]")
    return F.when(plain, name).otherwise(F.concat(F.lit('"'), name, F.lit('"')))


def literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def _put(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _names(list_: Column) -> Column:
    """A comma-separated list of names, each as it stands in a statement."""
    return F.array_join(F.transform(F.split(list_, ","), lambda c: quoted(F.trim(c))), ",")


def _values(list_: Column) -> Column:
    return F.array_join(F.transform(F.split(list_, ","), literal), ", ")


def definition(of, kind: Column, table: Column, name: Column) -> Column:
    """What an object is in a statement, behind CREATE or ADD; of(property) is a property's text, or null."""
    column = F.concat_ws(" ", quoted(name), F.upper(of("type")), F.when(of("nullable") == "false", F.lit("NOT NULL")), F.when(of("default").isNotNull(), _put("DEFAULT ", of("default"))))
    actions = F.concat_ws(" ", *(F.when(of(p).isNotNull(), _put(f"{p.upper().replace('_', ' ')} ", F.upper(of(p)))) for p in ("on_delete", "on_update")))
    refers = _put(quoted(of("referenced_table")), F.coalesce(_put(" (", _names(of("referenced_columns")), ")"), F.lit("")))
    deferred = F.when(of("deferrable") == "true", F.lit(" DEFERRABLE")).otherwise(F.lit(""))
    constraint = lambda *parts: _put("CONSTRAINT ", quoted(name), " ", *parts)
    return (
        F.when(kind == "column", column)
        .when(kind == "index", _put(F.when(of("unique") == "true", F.lit("UNIQUE ")).otherwise(F.lit("")), "INDEX ", quoted(name), " ON ", quoted(table), " (", _names(of("columns")), ")", F.coalesce(_put(" WHERE ", of("where")), F.lit(""))))
        .when(kind == "unique", constraint("UNIQUE (", _names(of("columns")), ")"))
        .when(kind == "check", constraint("CHECK (", of("expression"), ")"))
        .when(kind == "exclude", constraint("EXCLUDE ", of("expression")))
        .when(kind == "foreign_key", _put(F.rtrim(constraint("FOREIGN KEY (", _names(of("columns")), ") REFERENCES ", refers, " ", actions)), deferred))
        .when(kind == "view", _put("VIEW ", quoted(name), " AS ", of("select")))
        .when(kind == "enum", _put("TYPE ", quoted(name), " AS ENUM (", _values(of("values")), ")"))
    )


def _props(name: str) -> Column:
    return F.try_element_at(F.col("props"), F.lit(name))


def definitions(objects: DataFrame, kinds: tuple[str, ...] = ("column", "unique", "check", "exclude", "foreign_key")) -> DataFrame:
    """(table, sql): each table's CREATE statement, columns in order of their position and then constraints by name, from its objects.
    kinds: what of it is told."""
    part = definition(_props, F.col("kind"), F.col("table"), F.col("name"))
    place = F.struct((F.col("kind") != "column").alias("late"), F.coalesce(_props("position").try_cast("int"), F.lit(0)).alias("at"), F.col("name").alias("name"), part.alias("part"))
    parts = objects.where(F.col("kind").isin(*kinds)).groupBy("table").agg(F.array_sort(F.collect_list(place)).alias("parts"))
    return parts.select("table", _put("CREATE TABLE ", quoted(F.col("table")), " (", F.array_join(F.transform("parts", lambda p: p["part"]), ", "), ")").alias("sql"))


def with_hidden(ops: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """ops with what object_diff() leaves out of tables that come whole: indexes of new tables, and indexes and constraints of those
    that are made anew, whose old ones go first, as names of indexes are no table's own."""
    whole = ops.where("op IN ('create_table', 'recreate_table')").select("table", F.col("op").alias("__whole"))
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("props"))))
    none = F.lit(None).cast("string")

    def hidden(objects: DataFrame, verb: str, was: Column, now: Column) -> DataFrame:
        found = objects.where("kind IN ('index', 'unique', 'check', 'exclude', 'foreign_key')").join(whole, "table")
        kept = found.where("__whole = 'recreate_table'" if verb == "drop_" else "__whole = 'recreate_table' OR kind = 'index'")
        return kept.select(F.concat(F.lit(verb), "kind").alias("op"), "kind", "table", "name", was.alias("was"), now.alias("now"), F.lit("INFO").alias("severity"))

    return ops.unionByName(hidden(new, "add_", none, text)).unionByName(hidden(old, "drop_", text, none))


def statements(ops: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(seq, level, op, kind, table, name, sql) of ops from object_diff(old, new), as statements in the order in which they can be applied.

    New tables come with their columns; indexes and constraints follow, foreign keys once what they refer to is there. A table made anew is
    created beside, filled with the columns that both have, by name, and swapped, as one script; the old one stays as <name>__old. An
    enum that loses values is made anew and its columns are converted. Kinds without a statement are an error when the
    row is read.
    """
    old, new = kept(old, "old"), kept(new, "new")
    ops = in_order(kept(with_hidden(kept(ops, "ops"), old, new), "ops"), old, new)
    op, kind, t, n, was, now = (F.col(c) for c in ("op", "kind", "table", "name", "was", "now"))
    table, name = quoted(t), quoted(n)
    alter = lambda *parts: _put("ALTER TABLE ", table, " ", *parts)
    column = lambda *parts: alter("ALTER COLUMN ", name, " ", *parts)
    told = definition(lambda p: F.get_json_object("now", f"$.{p}"), kind, t, n)
    beside, aside = quoted(_put(t, "__new")), quoted(_put(t, "__old"))
    copied = F.coalesce(_put("INSERT INTO ", beside, " (", F.col("common"), ") SELECT ", F.col("common"), " FROM ", table, "; "), F.lit(""))
    anew = _put("CREATE TABLE ", beside, " (", F.col("body"), "); ", copied, "ALTER TABLE ", table, " RENAME TO ", aside, "; ALTER TABLE ", beside, " RENAME TO ", table)
    listed = lambda c: F.split(F.coalesce(c, F.lit("")), ",")
    more = F.array_join(F.transform(F.array_except(listed(now), listed(was)), lambda v: _put("ALTER TYPE ", name, " ADD VALUE ", literal(v))), "; ")
    cast = F.array_join(F.transform(F.coalesce("users", F.array().cast("array<struct<table:string,name:string>>")), lambda u: _put("ALTER TABLE ", quoted(u["table"]), " ALTER COLUMN ", quoted(u["name"]), " TYPE ", name, " USING ", quoted(u["name"]), "::text::", name, "; ")), "")
    remade = _put("ALTER TYPE ", name, " RENAME TO ", quoted(_put(n, "__old")), "; CREATE TYPE ", name, " AS ENUM (", _values(now), "); ", cast, "DROP TYPE ", quoted(_put(n, "__old")))
    fewer = (F.size(F.array_except(listed(was), listed(now))) > 0) | (more == "")
    constraints = kind.isin("unique", "check", "exclude", "foreign_key")
    said = lambda c: F.coalesce(literal(c), F.lit("NULL"))
    rules = [
        (op == "create_table", _put("CREATE TABLE ", table, " (", F.coalesce("body", F.lit("")), ")")), (op == "drop_table", _put("DROP TABLE ", table)), (op == "recreate_table", anew),
        (op == "add_column", alter("ADD COLUMN ", told)), (op == "drop_column", alter("DROP COLUMN ", name)),
        (op == "alter_column_type", column("TYPE ", now)),
        (op == "alter_column_nullable", column(F.when(now == "false", F.lit("SET NOT NULL")).otherwise(F.lit("DROP NOT NULL")))),
        (op == "alter_column_default", column(F.coalesce(_put("SET DEFAULT ", now), F.lit("DROP DEFAULT")))),
        (op == "alter_column_autoincrement", column(F.when(now == "true", F.lit("ADD GENERATED BY DEFAULT AS IDENTITY")).otherwise(F.lit("DROP IDENTITY")))),
        (op == "alter_column_comment", _put("COMMENT ON COLUMN ", table, ".", name, " IS ", said(now))), (op == "alter_table_comment", _put("COMMENT ON TABLE ", table, " IS ", said(now))),
        (op == "alter_option", alter(F.when(now.isNull(), _put("RESET (", name, ")")).otherwise(_put("SET (", name, " = ", said(now), ")")))),
        (op == "rename_unique", alter("RENAME CONSTRAINT ", quoted(was), " TO ", quoted(now))),
        (op == "alter_enum", F.when(fewer, remade).otherwise(more)),
        (op.isin("add_index", "create_view", "create_enum"), _put("CREATE ", told)),
        (op == "drop_index", _put("DROP INDEX ", name)), (op == "drop_view", _put("DROP VIEW ", name)), (op == "drop_enum", _put("DROP TYPE ", name)),
        (op.startswith("add_") & constraints, alter("ADD ", told)), (op.startswith("drop_") & constraints, alter("DROP CONSTRAINT ", name)),
    ]
    sql = F.raise_error(_put("no statement for ", op)).cast("string")
    for when, text in reversed(rules):
        sql = F.when(when, text).otherwise(sql)
    bodies = definitions(new, ("column",)).select(F.col("table").alias("__table"), F.regexp_extract("sql", r"(?s)\((.*)\)$", 1).alias("body"))
    side = lambda objects: objects.where("kind = 'column'").select("table", "name")
    common = side(old).intersect(side(new)).groupBy(F.col("table").alias("__both")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("name")), quoted), ", ").alias("common"))
    users = new.where("kind = 'column'").groupBy(_props("type").alias("__type")).agg(F.array_sort(F.collect_list(F.struct("table", "name"))).alias("users"))
    enums = users.join(new.where("kind = 'enum'").select(F.col("name").alias("__type")).distinct(), "__type")
    known = ops.join(bodies, t == F.col("__table"), "left").join(common, t == F.col("__both"), "left").join(enums, (kind == "enum") & (n == F.col("__type")), "left")
    return known.select("seq", "level", "op", "kind", "table", "name", sql.alias("sql"))
