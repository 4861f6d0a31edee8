"""All queries of the library and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spatialis.sources.standins import with_standins

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("matrix", "mapping", "space", "transfer", "perturbation", "jobs")


def query(name: str, sql: str | None = None, *standins: str) -> Callable[[Query], Query]:
    """Registers a query by a name; `sql` gives the same rows over the named stand-ins."""

    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = with_standins(sql, *standins) if standins else sql.strip()
        return f

    return register


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"spatialis.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
