"""Scalar functions on columns: dates, JSON, and the normalisation of SQL text, types and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.type_names import SQLITE_NAMES, SQLITE_OWN, TYPE_NAMES


def to_date(ts: Column) -> Column:
    return F.to_date(ts)


def today() -> Column:
    return F.current_date()


def start_of_hour(ts: Column) -> Column:
    """Of a timestamp without zone, one without zone."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def start_of(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def yyyymm(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("long")


def json_string(doc: Column, key: str) -> Column:
    return F.get_json_object(doc, f"$.{key}")


def json_double(doc: Column, key: str) -> Column:
    return json_string(doc, key).try_cast("double")


def json_timestamp(doc: Column, key: str) -> Column:
    return json_string(doc, key).try_cast("timestamp_ntz")


def interval_calls(sql: Column) -> Column:
    """INTERVAL n UNIT as toIntervalUnit(n), so that both spellings of a TTL compare equal."""
    units = ("Second", "Minute", "Hour", "Day", "Week", "Month", "Quarter", "Year")
    return reduce(lambda s, u: F.regexp_replace(s, rf"(?i)\bINTERVAL\s+'?(\d+)'?\s+{u}S?\b", f"toInterval{u}($1)"), units, sql)


def normal_default(value: Column) -> Column:
    """A default without casts, outer quotes or parentheses; the spellings of the current time are one, and so are those of
    true and of false."""
    bare = F.regexp_replace(F.trim(value), r"::[\w\s]+(\[\])?$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\((.*)\)$", "$1"), r"^'(.*)'$", "$1")
    now = F.lower(bare).isin("now()", "current_timestamp", "current_timestamp()", "localtimestamp", "getdate()")
    return F.when(value.isNull(), None).when(now, F.lit("now")).when(F.upper(bare).isin("TRUE", "FALSE"), F.upper(bare)).otherwise(bare)


def normal_index_column(name: Column) -> Column:
    """An index's column without cast, quotes and outer parentheses, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"::[\w\s]+$", ""), r'^[("`]+|[)"`]+$', ""))


def normal_type(name: Column) -> Column:
    """A type's common name: in lower case, without collation and wrappers; lengths of varchar and precisions of numeric
    stay. Unknown names are themselves in lower case."""
    low = F.lower(F.trim(F.regexp_replace(name, r"(?i)\s+collate\s+\S+", "")))
    low = reduce(lambda s, w: F.regexp_replace(s, rf"^{w}\((.*)\)$", "$1"), ("lowcardinality", "nullable", "lowcardinality", "nullable"), low)
    base = F.trim(F.regexp_replace(low, r"\(.*\)", ""))
    inner = F.regexp_replace(F.regexp_extract(low, r"\(([\d,\s]+)\)", 1), r"\s", "")
    known = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    plain = F.coalesce(F.try_element_at(known, base), base)
    keep = plain.isin("varchar", "char", "numeric") & (inner != "")
    return F.when(keep, F.concat(plain, F.lit("("), inner, F.lit(")"))).otherwise(plain)


def sqlite_type(name: Column, strict: bool = False) -> Column:
    """A type as SQLite takes it: those it has stay as they are written, others get its name for them; types it has nothing
    for are TEXT, or an error if strict. Nullable and low-cardinality wrappers say nothing; numerics lose their precision."""
    up = F.upper(F.regexp_replace(F.trim(name), r"\s+", " "))
    bare = reduce(lambda s, w: F.regexp_replace(s, rf"^{w}\((.+)\)$", "$1"), ("LOWCARDINALITY", "NULLABLE", "LOWCARDINALITY", "NULLABLE"), up)
    base = F.regexp_replace(bare, r"\(.*", "")
    known = F.create_map(*(F.lit(x) for pair in SQLITE_NAMES.items() for x in pair))
    whole = F.when((base == bare) | base.isin("DECIMAL", "DATETIME64", "FIXEDSTRING"), F.try_element_at(known, base)).when(base == "NUMERIC", F.lit("NUMERIC"))
    missing = F.raise_error(F.concat(F.lit("no SQLite type for "), name)).cast("string") if strict else F.lit("TEXT")
    own = reduce(Column.__or__, (bare.startswith(x) for x in SQLITE_OWN))
    return F.when(name.isNotNull(), F.coalesce(whole, F.when(own, name), missing))


def sqlite_default(value: Column, strict: bool = False) -> Column:
    """A default as SQLite takes it: null, or an error if strict, for calls that it doesn't have."""
    bad = F.upper(value).rlike(r"NOW\(\)|UUID_GENERATE_V4\(\)|GEN_RANDOM_UUID\(\)|NEXTVAL\(")
    lost = F.raise_error(F.concat(F.lit("no SQLite default for "), value)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(value.isNull() | (value == ""), F.lit(None).cast("string")).when(bad, lost).otherwise(value)


#: A piece of a statement that holds no cut: quoted text and names, dollar quotes, or anything else but what may begin one of these.
_QUOTED = r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|(\$\w*\$)[\s\S]*?\1"""


def statements(sql: Column) -> Column:
    """The statements of a script, cut at semicolons outside of quotes, quoted names and dollar quotes, without comments and blanks.
    A quote that isn't closed is an ordinary sign."""
    bare = F.regexp_replace(sql, rf"(?<q>{_QUOTED})|--[^\n]*|/\*[\s\S]*?\*/".replace(r"\1", r"\2"), "${q}")
    pieces = F.regexp_extract_all(bare, F.lit(rf"((?:{_QUOTED}|[^;'\"`$]++|[^;])+)".replace(r"\1", r"\2")), F.lit(1))
    # most statements of a log come alone: nothing in them begins a comment or is a cut
    pieces = F.when(sql.contains(";") | sql.contains("--") | sql.contains("/*"), pieces).otherwise(F.when(sql.isNotNull(), F.array(sql)))
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def normal_statement(sql: Column) -> Column:
    """A statement for comparison: one space for white space, no closing semicolon, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(sql, r"\s+", " ")), r"\s*;+\s*$", ""))


def reverse_statement(sql: Column) -> Column:
    """The statement that undoes a CREATE or ADD; a comment for what can't be undone."""
    name = r"(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`]+)"
    table, index, column = rf"(?is)^\s*CREATE\s+TABLE\s+{name}.*", rf"(?is)^\s*CREATE\s+(?:UNIQUE\s+)?INDEX\s+{name}.*", rf"(?is)^\s*ALTER\s+TABLE\s+([\w.\"`]+)\s+ADD\s+COLUMN\s+{name}.*"
    view = rf"(?is)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\s+{name}.*"
    return (
        F.when(sql.rlike(table), F.concat(F.lit("DROP TABLE "), F.regexp_extract(sql, table, 1)))
        .when(sql.rlike(index), F.concat(F.lit("DROP INDEX "), F.regexp_extract(sql, index, 1)))
        .when(sql.rlike(view), F.concat(F.lit("DROP VIEW "), F.regexp_extract(sql, view, 1)))
        .when(sql.rlike(column), F.concat(F.lit("ALTER TABLE "), F.regexp_extract(sql, column, 1), F.lit(" DROP COLUMN "), F.regexp_extract(sql, column, 2)))
        .otherwise(F.concat(F.lit("-- no automatic reversal: "), F.substring(sql, 1, 60)))
    )


def masked_password(url: Column) -> Column:
    """A connection URL with *** for its password."""
    return F.regexp_replace(url, r"(://[^:/@\s]+:)[^@/\s]*@", "$1***@")


def slug(text: Column, most: int = 50) -> Column:
    """Lower-case words joined by underscores, cut to a length."""
    return F.rtrim(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, most), F.lit("_"))


def plural(word: Column) -> Column:
    """An operation's name for several of them: policies, indexes, columns; what ends in s stays."""
    return F.when(word.endswith("s"), word).when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies")).when(word.rlike("(x|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def output_name(expression: Column) -> Column:
    """The name of a column that an SQL expression makes: what stands behind its last AS, or else the expression."""
    return F.trim(F.element_at(F.split(expression, r"(?i)\s+AS\s+"), -1))


def version_key(version: Column) -> Column:
    """A dotted version as numbers, which compare in the right order. A part that isn't a number counts as the number that it begins
    with, and as -1 without one: 2.0-rc is before 2.0.1, and is as 2.0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^\s*(\d+)", 1).try_cast("int"), F.lit(-1)))


def qualified(sql: Column, database: str) -> Column:
    """A query with its first FROM's table qualified, if it isn't."""
    return F.regexp_replace(sql, r"(?is)^(.*?\bFROM\s+)(?![\w`\"]+\.)([\w`\"]+)", f"$1{database}.$2")
