"""Operations as statements, with the statements that undo them and whether that loses data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.schema_diff import ordered


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def rendered(ops: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(seq, op, sql, rollback, irreversible): ops (op, table, name, detail) in order, as SQL.

    columns: the columns relation that tables are created from; without it they have none. A rollback of a drop brings back
    the structure, not the rows, so it is marked irreversible; kinds without a statement are an error.
    """
    t, n, d = F.col("table"), F.col("name"), F.col("detail")
    was, now = F.split(d, " -> ")[0], F.split(d, " -> ")[1]
    alter = lambda *p: _text("ALTER TABLE ", t, " ", *p)
    null = lambda v: F.when(v == "true", alter("ALTER COLUMN ", n, " DROP NOT NULL")).otherwise(alter("ALTER COLUMN ", n, " SET NOT NULL"))
    default = lambda v: F.when(v == "null", alter("ALTER COLUMN ", n, " DROP DEFAULT")).otherwise(alter("ALTER COLUMN ", n, " SET DEFAULT ", v))
    body = F.coalesce(F.col("body"), F.lit(""))
    rules = {
        "create_table": (_text("CREATE TABLE ", t, " (", body, ")"), _text("DROP TABLE ", t)),
        "drop_table": (_text("DROP TABLE ", t), _text("CREATE TABLE ", t, " (", body, ")")),
        "rename_table": (alter("RENAME TO ", d), _text("ALTER TABLE ", d, " RENAME TO ", t)),
        "add_column": (alter("ADD COLUMN ", n, " ", d), alter("DROP COLUMN ", n)),
        "drop_column": (alter("DROP COLUMN ", n), alter("ADD COLUMN ", n, " ", d)),
        "rename_column": (alter("RENAME COLUMN ", n, " TO ", d), alter("RENAME COLUMN ", d, " TO ", n)),
        "alter_column_type": (alter("ALTER COLUMN ", n, " TYPE ", now), alter("ALTER COLUMN ", n, " TYPE ", was)),
        "alter_column_nullable": (null(now), null(was)),
        "alter_column_default": (default(now), default(was)),
        "add_index": (_text("CREATE INDEX ", n, " ON ", t, " (", d, ")"), _text("DROP INDEX ", n)),
        "drop_index": (_text("DROP INDEX ", n), _text("CREATE INDEX ", n, " ON ", t, " (", d, ")")),
    }

    def chosen(side: int) -> Column:
        unknown = F.raise_error(_text("no statement for ", F.col("op"))).cast("string")
        first, *rest = rules.items()
        return reduce(lambda c, r: c.when(F.col("op") == r[0], r[1][side]), rest, F.when(F.col("op") == first[0], first[1][side])).otherwise(unknown)

    if columns is None:
        known = ops.withColumn("body", F.lit(None).cast("string"))
    else:
        line = F.concat_ws(" ", F.col("name"), F.upper("type"), F.when(~F.col("nullable"), F.lit("NOT NULL")), F.when(F.col("default").isNotNull(), F.concat(F.lit("DEFAULT "), F.col("default"))))
        bodies = columns.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s.line), ", ").alias("body"))
        known = ops.join(bodies, "table", "left")
    return ordered(known).select("seq", "op", chosen(0).alias("sql"), chosen(1).alias("rollback"), F.col("op").isin("drop_table", "drop_column").alias("irreversible"))
