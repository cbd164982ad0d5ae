"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "C5"


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Registers a function (spark, sf_dir) under a name, with the SQL of the same result."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql() if callable(sql) else sql
        return f

    return add


from . import annotation_queries, market_queries, release_queries, review_queries, source_queries, text_queries  # noqa: E402,F401
