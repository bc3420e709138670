"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Literal cases, with their SQL, of queries that are registered again over the tables: tests run them.
CASES: dict[str, tuple[Query, str]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if f.__name__ in QUERIES:
            CASES[f.__name__] = QUERIES[f.__name__], ORACLE_SQL.pop(f.__name__)
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put
