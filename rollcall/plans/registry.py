"""A registry of queries: a function over the tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans.data import Data

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    queries: dict[str, Query] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def put(f: Callable[[Data], DataFrame]):
            queries[f.__name__] = lambda spark, root: f(Data(spark, root))
            if sql:
                sqls[f.__name__] = sql
            return f

        return put

    return queries, sqls, query
