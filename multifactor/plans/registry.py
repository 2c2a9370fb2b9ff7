"""Collects the queries and the oracle SQL of every plan module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from multifactor.plans import factors, statistics

MODULES = (statistics, factors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name, for the queries that SQL can express."""
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
