"""Queries over the driver's tables and their DuckDB equivalents, gathered from the operator packages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Adds a query under a name, with its DuckDB equivalent if SQL can express it."""

    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return add
