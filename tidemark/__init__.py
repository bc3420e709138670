"""Spark-first rollups, table semantics and schema audits."""

__version__ = "0.1.0"
