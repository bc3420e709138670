"""What a schema is once a log of statements has run, without running it.

Statements become events on names: a table, column, constraint or index comes, goes or is renamed. Between coming and going a name
has a life, and a life that began with a rename goes on with that of the old name: these chains are followed by doubling
their pointers. Each event is led to its life by one sort of all events by name, once for tables and once for what they hold. Names with very many
events are cut into runs, so the log is dealt out over all tasks, whatever its length and however many times one table is changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.places import kept

#: Parts of a statement, and statements of a run in which a hot name's events are sorted together.
PARTS, RUN = 1 << 20, 1000
#: Hashes by which names are counted, and rows of a hash from which on its names are cut into runs.
HASHES, HOT = 1 << 16, 1_000_000

NAME = r"""("(?:[^"]|"")+"|`[^`]+`|[\w.$]++)"""
_END = r"\s*;?\s*$"
_TABLE = rf"(?is)^\s*ALTER\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?(?:ONLY\s+)?{NAME}\s+"
#: What a statement does, by its pattern: action, kind, and which groups are table, name, other name and type.
RULES = (
    (rf"(?is)^\s*CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\((.*)\).*$", "create", "table", 1, 1, 0, 2),
    (rf"(?is)^\s*DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?{NAME}.*$", "drop", "table", 1, 1, 0, 0),
    (rf"{_TABLE}RENAME\s+TO\s+{NAME}{_END}", "rename", "table", 1, 1, 2, 0),
    (rf"{_TABLE}ADD\s+CONSTRAINT\s+{NAME}(.*)$", "add", "constraint", 1, 2, 0, 3),
    (rf"{_TABLE}DROP\s+CONSTRAINT\s+(?:IF\s+EXISTS\s+)?{NAME}.*$", "drop", "constraint", 1, 2, 0, 0),
    (rf"{_TABLE}RENAME\s+CONSTRAINT\s+{NAME}\s+TO\s+{NAME}{_END}", "rename", "constraint", 1, 2, 3, 0),
    (rf"{_TABLE}ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s+(.*?){_END}", "add", "column", 1, 2, 0, 3),
    (rf"{_TABLE}DROP\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?{NAME}.*$", "drop", "column", 1, 2, 0, 0),
    (rf"{_TABLE}RENAME\s+(?:COLUMN\s+)?{NAME}\s+TO\s+{NAME}{_END}", "rename", "column", 1, 2, 3, 0),
    (rf"{_TABLE}(?:ALTER\s+(?:COLUMN\s+)?{NAME}\s+(?:SET\s+DATA\s+)?TYPE)\s+(.*?){_END}", "type", "column", 1, 2, 0, 3),
    (rf"{_TABLE}MODIFY\s+(?:COLUMN\s+)?{NAME}\s+(.*?){_END}", "type", "column", 1, 2, 0, 3),
    (rf"(?is)^\s*CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s+ON\s+{NAME}(.*?){_END}", "add", "index", 2, 1, 0, 3),
    (rf"(?is)^\s*DROP\s+INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+EXISTS\s+)?{NAME}.*$", "drop", "index", 0, 1, 0, 0),
)
#: Items of a CREATE TABLE's body: parentheses may hold others.
ITEM = r"((?:[^(),']++|'(?:[^']|'')*'|\((?:[^()]++|\((?:[^()]++|\([^()]*\))*\))*\))+)"
_CONSTRAINT = rf"(?is)^\s*CONSTRAINT\s+{NAME}(.*)$"
_COLUMN = rf"(?is)^\s*{NAME}\s+(.*)$"


def _bare(name: Column) -> Column:
    """A name without its quotes."""
    return F.when(name.startswith('"'), F.replace(F.regexp_replace(name, r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))).when(name.startswith("`"), F.regexp_replace(name, r"^`(.*)`$", "$1")).otherwise(name)


def _type(text: Column) -> Column:
    """A column's type: what stands before its first constraint."""
    return F.trim(F.regexp_replace(text, r"(?is)\s+(NOT\s+NULL|NULL|DEFAULT|PRIMARY\s+KEY|UNIQUE|CHECK|REFERENCES|CONSTRAINT|GENERATED|COLLATE|USING|CODEC|TTL|COMMENT)\b.*$", ""))


def events(statements: DataFrame) -> DataFrame:
    """(at, made, action, table, kind, name, other, type) of statements (seq, sql), several statements in a sql told apart by semicolons outside of
    quotes. Those that do nothing to tables, columns, constraints and indexes have none; made is the at of the CREATE TABLE whose item it is.

    All of it is steps on arrays: as columns of one plan the rules become a method too long to be compiled, and cost several times as much.
    """
    from tidemark.functions.scalars import statements as cut

    none = F.lit(None).cast("string")
    fields = ("action", "table", "kind", "name", "other", "type")
    event = lambda *values: F.struct(*(v.alias(f) for f, v in zip(fields, values, strict=True)))

    def ruled(sql: Column) -> Column:
        rule = F.lit(None).cast("int")
        for i, (pattern, *_) in reversed(list(enumerate(RULES))):
            rule = F.when(sql.rlike(pattern), F.lit(i)).otherwise(rule)
        return F.struct(sql.alias("sql"), rule.alias("rule"))

    def told(s: Column) -> Column:
        """The fields of a statement's rule: action and kind, and what its groups hold. Patterns are literals, so each is compiled once."""

        def field(number: int) -> Column:
            found = none
            for i, rule in enumerate(RULES):
                if rule[number]:
                    found = F.when(s["rule"] == i, F.lit(rule[number]) if number < 3 else F.regexp_extract(s["sql"], rule[0], rule[number])).otherwise(found)
            return found

        return F.struct(*(field(i).alias(f) for i, f in enumerate(("action", "kind", "table", "name", "other", "rest"), 1)))

    def named(s: Column) -> Column:
        typed = F.when(s["kind"] == "column", _type(s["rest"])).otherwise(F.trim(s["rest"]))
        return F.struct(s["rest"].alias("rest"), event(s["action"], _bare(s["table"]), s["kind"], _bare(s["name"]), _bare(s["other"]), typed).alias("e"))

    is_key = lambda x: x.rlike(r"(?is)^\s*(PRIMARY|UNIQUE|CHECK|FOREIGN|EXCLUDE|INDEX|KEY|LIKE)\b")
    item = lambda x: F.struct(x.alias("text"), x.rlike(_CONSTRAINT).alias("constraint"))
    group = lambda x, i: F.when(x["constraint"], F.regexp_extract(x["text"], _CONSTRAINT, i)).otherwise(F.regexp_extract(x["text"], _COLUMN, i))
    halves = lambda x: F.struct(x["constraint"].alias("constraint"), group(x, 1).alias("name"), group(x, 2).alias("rest"))

    def rows(s: Column) -> Column:
        e = s["e"]
        part = lambda x: event(F.lit("add"), e["table"], F.when(x["constraint"], F.lit("constraint")).otherwise(F.lit("column")), _bare(x["name"]), none, F.when(x["constraint"], F.trim(x["rest"])).otherwise(_type(x["rest"])))
        items = F.filter(F.regexp_extract_all(s["rest"], F.lit(ITEM), F.lit(1)), lambda x: (F.trim(x) != "") & ~is_key(x))
        parts = F.transform(F.transform(F.transform(items, item), halves), part)
        made = (e["action"] == "create") & (e["kind"] == "table")
        return F.when(made, F.concat(F.array(event(e["action"], e["table"], e["kind"], e["name"], e["other"], none)), parts)).when(e["action"].isNotNull(), F.array(e))

    # dealt out first: a log may lie in few files, and its patterns are most of the work
    steps = cut(F.col("sql"))
    for step in (ruled, told, named, rows):
        steps = F.transform(steps, step)
    one = statements.select("seq", "sql").repartition("seq").select("seq", F.posexplode(steps).alias("k", "rows"))
    begun = F.col("seq").cast("long") * PARTS + F.col("k") * 1000
    return one.select(begun.alias("begun"), F.posexplode("rows").alias("i", "e")).select((F.col("begun") + F.col("i")).alias("at"), F.when(F.col("i") > 0, F.col("begun")).alias("made"), "e.*")


def first_of_chains(links: DataFrame) -> DataFrame:
    """(id, first) of links (id, before): pointers are doubled until none leads to one that has a pointer of its own."""
    found = links.select("id", F.col("before").alias("first"))
    while found.join(found.select(F.col("id").alias("first")), "first", "left_semi").limit(1).count():
        step = found.select(F.col("id").alias("first"), F.col("first").alias("then"))
        found = kept(found.join(step, "first", "left").select("id", F.coalesce("then", "first").alias("first")), "chains")
    return found


def _run(at: Column) -> Column:
    return F.floor(at / (PARTS * RUN))


def _steps(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with life and early, by the rows before them of the same by; see _followed(). early: none of these is an end."""
    before = Window.partitionBy(*by).orderBy("at", "does").rowsBetween(Window.unboundedPreceding, -1)
    told = F.when(F.col("does") != 0, F.col("does"))
    there = rows.withColumn("there", F.coalesce(F.last(told, ignorenulls=True).over(before) == 1, F.lit(False)))
    begun = F.when((F.col("does") == 1) & ~F.col("there"), F.col("id"))
    led = F.when(F.col("there"), F.last(begun, ignorenulls=True).over(before))
    early = ~F.coalesce(F.bool_or(F.col("does") == -1).over(before), F.lit(False))
    return there.withColumn("life", F.when(F.col("does") == 1, begun).otherwise(led)).withColumn("early", early).drop("there")


def _followed(rows: DataFrame) -> DataFrame:
    """rows (of, name, at, does, id and others) with the life each is led to.

    does is 1 where something comes under the name of its owner, -1 where it goes, 0 where nothing changes. A beginning has its id as life, or none if
    the name is there already: then it says nothing. Any other row has the life that is there just before it, if there is one.

    Rows are sorted by name. Names with more than HOT rows, found by counts of hashes, are cut into runs that are sorted apart; a run's rows up to its first end
    go on with the life that is there at its beginning, which comes from a sort of what each run leaves.
    """
    by = ["of", "name"]
    mixed = F.pmod(F.xxhash64(*by), F.lit(HASHES))
    hot = [r.h for r in rows.groupBy(mixed.alias("h")).count().where(F.col("count") > HOT).collect()]
    if not hot:
        return _steps(rows, by).drop("early")
    many = mixed.isin(hot)
    parts = kept(_steps(rows.where(many).withColumn("run", _run(F.col("at"))), [*by, "run"]), "runs")
    marks = parts.where("does = -1 OR does = 1 AND life IS NOT NULL")
    left = marks.groupBy(*by, "run").agg(F.min("does").alias("least"), F.max_by(F.when(F.col("does") == 1, F.col("life")), F.struct("at", "does")).alias("id"))
    step = lambda df, place, does, life: df.select(*by, "run", (F.col("run") * 3 + place).alias("at"), F.lit(does).alias("does"), life.alias("id"))
    none = F.lit(None).cast("long")
    asked = step(parts.select(*by, "run").distinct(), 0, 0, none)
    runs = asked.unionByName(step(left.where("least = -1"), 1, -1, none)).unionByName(step(left.where("id IS NOT NULL"), 2, 1, F.col("id")))
    inherited = _steps(runs, by).where("does = 0 AND life IS NOT NULL").select(*(F.col(c).alias(f"_{c}") for c in (*by, "run")), F.col("life").alias("inherited"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "run")))
    goes_on = F.col("early") & F.col("inherited").isNotNull()
    whole = parts.join(inherited, same, "left").withColumn("life", F.when(goes_on, F.when(F.col("does") != 1, F.col("inherited"))).otherwise(F.col("life")))
    return _steps(rows.where(~many), by).drop("early").unionByName(whole.select(*rows.columns, "life"))


def _with_first(rows: DataFrame) -> DataFrame:
    """rows that _followed() gave, with the first life of the chain of renames that their life belongs to. Only lives that began with a rename, whose ids are
    odd, are looked up."""
    links = rows.where("does = -1 AND other IS NOT NULL AND life IS NOT NULL").select((F.col("at") * 2 + 1).alias("id"), F.col("life").alias("before"))
    later = F.coalesce(F.pmod("life", F.lit(2)) == 1, F.lit(False))
    chains = first_of_chains(links).select(F.col("id").alias("life"), "first")
    renamed = rows.where(later).join(chains, "life", "left").withColumn("first", F.coalesce("first", "life"))
    return rows.where(~later).withColumn("first", F.col("life")).unionByName(renamed.select(*rows.columns, "first"))


def _rows(changes: DataFrame, comes: str, goes: str) -> DataFrame:
    """Rows for _followed() of changes (of, name, other, at, action and others): a rename is two, an end under the name and a beginning under the other,
    where name and other change places."""
    does = F.when(F.expr(comes), 1).when(F.expr(goes) | (F.col("action") == "rename"), -1).otherwise(0)
    began = changes.where("action = 'rename'").withColumns({"name": F.col("other"), "other": F.lit(None).cast("string"), "does": F.lit(1), "id": F.col("at") * 2 + 1})
    return changes.withColumn("does", does).withColumn("id", F.when(F.expr(comes), F.coalesce("id", F.col("at") * 2))).unionByName(began)


def replayed(columns: DataFrame, statements: DataFrame) -> DataFrame:
    """(table, kind, name, type) of the columns, constraints and indexes that are there after columns (table, name, type), and with kind other
    things too, have gone through statements (seq, sql).

    Tables and columns that are made again while they are there stay as they are; what isn't there can't be dropped or renamed.
    A column added to a table that isn't there makes it. Indexes and constraints go with their table; type is what
    stands behind their name. seq is unique and not negative.
    """
    kind = F.col("kind") if "kind" in columns.columns else F.lit("column")
    none, number, nobody = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit("")
    log = kept(events(statements), "events").withColumn("id", number)
    # what is there at the start has numbers below zero
    below = -2 - F.monotonically_increasing_id() * 2
    there = lambda df, at, action: df.select(F.lit(at).cast("long").alias("at"), number.alias("made"), F.lit(action).alias("action"), "table", "kind", "name", none.alias("other"), "type", below.alias("id"))
    tables = there(columns.select("table", F.lit("table").alias("kind"), F.col("table").alias("name"), none.alias("type")).distinct(), -2, "create")
    start = kept(tables.unionByName(there(columns.select("table", kind.alias("kind"), "name", "type").where("name IS NOT NULL"), -1, "add")), "start")
    # each row goes by its table's name; what a column, constraint or index is called is kept beside it
    told = log.unionByName(start).select(nobody.alias("of"), F.col("table").alias("name"), F.when(F.col("kind") == "table", F.col("other")).alias("other"), "at", F.when(F.col("kind") == "table", F.col("action")).alias("action"), "id", "made", F.struct("action", "kind", "name", "other", "type", "id").alias("inner"))
    rows = _rows(told, "coalesce(action = 'create', false)", "coalesce(action = 'drop', false)")
    # a statement that names no table, as DROP INDEX, has no life to be led to
    found = _followed(rows.where("name IS NOT NULL")).unionByName(rows.where("name IS NULL").withColumn("life", number))
    found = _with_first(kept(found, "tables"))
    # the items of a CREATE TABLE that said nothing say nothing either
    inner = found.where("inner.kind <> 'table' AND (made IS NULL OR life = made * 2)")
    owner = F.coalesce(F.col("first").cast("string"), F.concat(F.lit("?"), "name"))
    of = F.concat_ws("|", F.col("inner.kind"), F.when(F.col("inner.kind") == "index", F.lit("")).otherwise(owner))
    inner = inner.select(of.alias("of"), "inner.name", "inner.other", "at", "inner.action", "inner.id", "inner.kind", "inner.type", F.col("first").alias("owner"), F.col("name").alias("table"))
    inside = kept(_followed(_rows(kept(inner, "inner"), "action = 'add'", "action = 'drop'")), "inside")
    inside = _with_first(inside).where("first IS NOT NULL")
    # the type is the last one told in a life's chain; an addition tells one only where it began the life, and the last mark tells whether it goes on
    tells = F.when(F.expr("action IN ('add', 'type')"), F.col("at"))
    mark = F.when(F.col("does") != 0, F.struct("at", "does"))
    ends = inside.groupBy("first").agg(F.max_by(F.struct("does", "kind", "name"), mark).alias("last"), F.max_by("type", tells).alias("type"), F.min_by(F.struct("owner", "table"), tells).alias("home"))
    left = ends.where("last.does = 1 AND home IS NOT NULL").select("last.kind", "last.name", "type", "home.owner", F.col("home.table").alias("made_in"))
    homes = found.where("inner.kind = 'table' AND first IS NOT NULL").groupBy(F.col("first").alias("owner")).agg(F.max_by(F.struct("does", "name"), mark).alias("last")).where("last.does = 1").select("owner", F.col("last.name").alias("table"))
    whole = left.join(homes, "owner", "left").withColumn("table", F.coalesce("table", F.when(F.col("owner").isNull(), F.col("made_in"))))
    return whole.where("table IS NOT NULL").select("table", "kind", "name", "type")
