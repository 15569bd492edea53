"""All queries of the library outside `framelake.llm`, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"two queries are named {name}")
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


#: Modules that register queries when they are imported.
SUITES = ("video", "timeline", "stats", "audio", "io", "relational")


def _load() -> None:
    for name in SUITES:
        import_module(f"framelake.suites.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
