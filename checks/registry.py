"""The list of queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatstrata.session import configure
from checks.fixtures import register_tables, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Fixture views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        register_tables(spark, sf_dir)

    def __call__(self, sql: str) -> DataFrame:
        return view(self.spark, sql)


def check(oracle: str | None = None):
    """Register a query ``(tables) -> DataFrame`` under its function name."""

    def register(query: Callable[[Tables], DataFrame]):
        name = query.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(Tables(configure(spark), sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return query

    return register
