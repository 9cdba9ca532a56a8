"""All queries of the engine by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_PLANS = ("browse", "requests", "corpus", "channels", "rollups", "resolution", "enrichment", "learning", "changes")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is None where SQL can't say it."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for plan in _PLANS:
        import_module(f"sensemill.plans.{plan}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
