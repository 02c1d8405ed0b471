"""Queries of this package and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query of (spark, folder); ``check`` is DuckDB SQL for the same rows."""

    def add(build):
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return add
