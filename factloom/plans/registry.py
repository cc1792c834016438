"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (tables) -> DataFrame under its name; ``tables(name)`` reads a table."""

    def register(build: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register
