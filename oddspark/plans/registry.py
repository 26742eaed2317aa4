"""Named queries over the given tables and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddspark.sources.given import Given

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(given)`` under ``name``."""

    def register(f: Callable[[Given], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Given(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register
