"""All queries of the library by name, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "lut_project_agg"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and SQL for the same rows."""

    def register(function):
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return register


def _load() -> None:
    """Import the modules that register queries."""
    from maskframe.plans import label_queries, metric_queries, raster_queries, selection_queries, source_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
