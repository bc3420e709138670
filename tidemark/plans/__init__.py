"""Queries over the test tables, by name. Those of histories take the place of the same ones over literal rows, which tests still run."""

from tidemark.plans import analytics, extras, objects, schemas, storage  # isort: skip
from tidemark.plans import histories
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "extras", "histories", "objects", "schemas", "storage"]
