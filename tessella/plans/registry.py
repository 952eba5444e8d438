"""The queries by name, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query, with its SQL after the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(views)} " if views and not sql.lstrip().startswith(",") else f"WITH {', '.join(views)}" if views else "") + sql
        return f

    return add
