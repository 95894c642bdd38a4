"""All registered queries and their SQL twins. A module of this package registers its own by the decorator `query`."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
MODULES = ("sources", "projections", "joins", "aggregates", "windows", "selection", "scalars", "streams")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the DuckDB text of the same result where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"gleaner.plans.{name}_queries")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
