"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratlas.session import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register a function of DataFrames as the query ``name`` over ``tables``, with its SQL if SQL can express it."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf: function(*[read(spark, sf, t) for t in tables])
        if sql:
            SQL[name] = sql
        return function

    return add
