"""All case queries by name, with the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketspark.sources.binding import Tables, with_tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("report", "listing", "similar", "scalar", "ingest", "derived", "rules")


def query(name: str, sql: str | None = None):
    """Register a function of the case tables as a query; sql: DuckDB text over the case tables' names."""

    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = with_tables(sql)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"docketspark.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
