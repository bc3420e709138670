"""How grave a change of a schema is, as column expressions: of types, enums, options and engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of row-store types, by the kind that changes are judged by.
KINDS = {
    "integer": "int integer int4 tinyint smallint int2 serial smallserial",
    "biginteger": "bigint int8 bigserial",
    "char": "char nchar character",
    "varchar": "varchar|character varying|string|fixedstring|ipv4|ipv6",
    "text": "text longtext clob mediumtext",
    "boolean": "boolean bool bit",
    "timestamp": "timestamp|datetime|datetime64|timestamp without time zone",
    "timestamptz": "timestamptz|timestamp with time zone",
    "date": "date date32",
    "float": "float|double|double precision|float64",
    "float32": "float32 real",
    "numeric": "numeric decimal",
    "json": "json",
    "jsonb": "jsonb",
    "bytes": "bytea blob binary varbinary longblob",
    "enum": "enum enum8 enum16",
}
KIND_OF = {name: kind for kind, names in KINDS.items() for name in (names.split("|") if "|" in names else names.split())}
#: Options and column properties of column-store tables whose change is critical, or a warning; of others it is told.
CRITICAL_OPTIONS = ("engine_raw", "order_by", "object_type", "select_statement", "to_table", "dictionary")
WARN_OPTIONS = ("settings", "zookeeper_path", "replica_name", "dict_layout", "dict_source", "dict_lifetime", "dict_primary_key")
CRITICAL_PROPERTIES = ("low_cardinality", "nullable")
WARN_PROPERTIES = ("codec", "default_expression", "materialized", "alias", "ephemeral", "ttl")
#: Engines that may merge rows away, and those known to keep each.
LOSSY = ("aggregatingmergetree", "collapsingmergetree", "replacingmergetree", "summingmergetree", "versionedcollapsingmergetree")
KEEPING = ("log", "memory", "mergetree", "replicatedmergetree", "stripelog", "tinylog")


def type_parts(name: Column) -> Column:
    """struct(kind, size): a type's kind, or its own name where that isn't known, and the first number in its parentheses."""
    low = F.lower(F.trim(F.regexp_replace(name, r"(?i)\s+collate\s+\S+", "")))
    for wrapper in ("nullable", "lowcardinality", "nullable"):
        low = F.regexp_replace(low, rf"^{wrapper}\((.*)\)$", "$1")
    base = F.trim(F.regexp_replace(F.regexp_replace(low, r"\(.*?\)", ""), r"\s+", " "))
    known = F.create_map(*(F.lit(x) for pair in KIND_OF.items() for x in pair))
    return F.struct(F.coalesce(F.try_element_at(known, base), base).alias("kind"), F.regexp_extract(low, r"\(\s*(\d+)", 1).try_cast("int").alias("size"))


def type_change_class(old: Column, new: Column) -> Column:
    """SAFE, WARN or CRITICAL. Safe are equal kinds, longer or unlimited varchars, integer to bigint, varchar to text and json to jsonb; a change
    between timestamps with and without a zone is a warning; a shorter varchar, a numeric of less precision and any other
    change of kind are critical."""
    a, b = type_parts(old), type_parts(new)
    is_ = lambda x, y: (a["kind"] == x) & (b["kind"] == y)
    return (
        F.when(is_("varchar", "varchar"), F.when(a["size"].isNull() | b["size"].isNull() | (b["size"] >= a["size"]), F.lit("SAFE")).otherwise(F.lit("CRITICAL")))
        .when(is_("integer", "biginteger") | is_("varchar", "text") | is_("json", "jsonb"), F.lit("SAFE"))
        .when(is_("timestamp", "timestamptz") | is_("timestamptz", "timestamp"), F.lit("WARN"))
        .when((a["kind"] != b["kind"]) | ((a["kind"] == "numeric") & F.coalesce(b["size"] < a["size"], F.lit(False))), F.lit("CRITICAL"))
        .otherwise(F.lit("SAFE"))
    )


def enum_change_class(old: Column, new: Column) -> Column:
    """CRITICAL if a value goes, WARN if one comes, SAFE if only their order changes; lists of values."""
    return F.when(F.size(F.array_except(old, new)) > 0, F.lit("CRITICAL")).when(F.size(F.array_except(new, old)) > 0, F.lit("WARN")).otherwise(F.lit("SAFE"))


def option_change_class(option: Column) -> Column:
    """Of a column-store table's option by its name: CRITICAL, WARN or INFO."""
    return F.when(option.isin(*CRITICAL_OPTIONS), F.lit("CRITICAL")).when(option.isin(*WARN_OPTIONS), F.lit("WARN")).otherwise(F.lit("INFO"))


def property_change_class(name: Column, old: Column, new: Column) -> Column:
    """Of a column-store column's property: a type is critical if aggregate states are on either side, else a warning."""
    states = F.coalesce(F.contains(old, F.lit("AggregateFunction")), F.lit(False)) | F.coalesce(F.contains(new, F.lit("AggregateFunction")), F.lit(False))
    return (
        F.when(name == "type", F.when(states, F.lit("CRITICAL")).otherwise(F.lit("WARN")))
        .when(name.isin(*CRITICAL_PROPERTIES), F.lit("CRITICAL"))
        .when(name.isin(*WARN_PROPERTIES), F.lit("WARN"))
        .otherwise(F.lit("INFO"))
    )


def engine_change_class(old: Column, new: Column) -> Column:
    """conditional if both engines are known to keep each row, so that a change can be undone; else irreversible."""
    family = lambda c: F.lower(F.trim(F.split(c, r"\(")[0]))
    return F.when(F.coalesce(family(old).isin(*KEEPING) & family(new).isin(*KEEPING), F.lit(False)), F.lit("conditional")).otherwise(F.lit("irreversible"))
