"""Binds each query to its SQL.  Modules of this package register theirs when imported."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Modules that register queries.
MODULES: tuple[str, ...] = ("gate_queries", "evalset_queries", "corpus_queries", "model_queries", "design_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL that gives the same rows in DuckDB."""

    def keep(f: Query) -> Query:
        if name in _QUERIES and _QUERIES[name] is not f:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidewell.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
