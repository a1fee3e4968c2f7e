"""Registration of queries with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Section:
    """The queries of one module; a query's key is its function's name without a trailing underscore."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            key = f.__name__.rstrip("_")
            self.queries[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; column pruning and pushed filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
