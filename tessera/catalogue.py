"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLANS = ("graph", "search", "text", "metrics", "vector", "learning", "select", "parse", "streams", "packet", "routing", "context", "memory", "tasks")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def load() -> None:
    for name in PLANS:
        import_module(f"tessera.plans.{name}")


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(SQL)
