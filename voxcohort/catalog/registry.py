"""Registry of the driver queries: a Spark callable and, where it exists, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given parquet tables as attributes; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(expression: str, digits: int = 6) -> str:
    """SQL text of a rounded double without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"
