"""The queries of the matching engine by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *parts: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = "WITH " + "RECURSIVE " * recursive + ",\n".join(p.strip() for p in parts) + "\n" + sql.strip() if parts else sql.strip()
        return f

    return add
