"""Registry of the bound queries and the table readers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def query(name: str, sql: str | None = None):
    """Register a query and the SQL it must agree with."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """An input binding: SQL text valid in Spark and in the oracle engine, tables written as {name}."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def plain(text: str) -> str:
    """The same binding for the oracle, table names as they are."""
    return text.format(**{t: t for t in TABLES})
