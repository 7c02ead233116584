"""Table readers: an explicit schema each time, many files as one frame, set names from paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import METRICS, RAW_PROBLEM

_SET_NAME = r"/([^/]+?)\.parquet(?:/[^/]*)?$"


def read_tables(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """One or many parquet paths as one frame."""
    many = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).parquet(*many)


def read_splits(spark: SparkSession, splits: dict[str, str | Sequence[str]], schema: T.StructType | str) -> DataFrame:
    """Named splits (train, val, ...) with a ``split`` column."""
    out = None
    for name, paths in splits.items():
        part = read_tables(spark, paths, schema).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no splits given")
    return out


def read_named_sets(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Many ``<name>.parquet`` paths in one scan, with the name of each row's set in ``set_name``."""
    return read_tables(spark, paths, schema).withColumn(
        "set_name", F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_path"), _SET_NAME, 1), F.lit("+"), F.lit("%2B"))))


def read_raw_problems(spark: SparkSession, path: str) -> DataFrame:
    return read_tables(spark, path, RAW_PROBLEM)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path)


def load_batch(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return read_tables(spark, path, schema)
