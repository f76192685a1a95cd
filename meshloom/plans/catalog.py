"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics_queries, core_problems, search_queries

_MODULES = (core_problems, analytics_queries, search_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search_queries.search(spark, folder)
