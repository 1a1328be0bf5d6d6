"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.plans.adapters import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Tables and views of one data folder: ``src("pages")``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(src) -> DataFrame`` and, when given, the SQL it must equal."""

    def register(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Source(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
