"""Registers queries by name with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viatica.sources.bridge import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *views: str):
    """For a function of the named views, as DataFrames; sql is DuckDB's, over the same views."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views]) if views else f(spark, sf_dir)
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return put
