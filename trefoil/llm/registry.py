"""Queries of the training-data operators, and the SQL that states their answers."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, folder) -> DataFrame`` under a name."""
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return register
