"""The register of queries: a function of (spark, sf_dir) and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(ops: str, sql: str | None = None):
    """Register a function under its name; ``ops`` are the identifiers of the operators it exercises."""

    def put(f):
        QUERIES[f.__name__] = f
        OPERATORS[f.__name__] = ops
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
