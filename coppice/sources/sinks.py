"""Sinks. Everything is written by the executors; reports are one aggregated row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import metrics_line

METRIC_BACKENDS = ("table", "console")


def write_records(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_batch(df: DataFrame, path: str) -> None:
    write_records(df, path)


def write_generations(df: DataFrame, path: str, order: str, max_items: int = -1) -> None:
    """Rows as JSON records; the first ``max_items`` by ``order`` when it is positive, otherwise all."""
    out = df.orderBy(order).limit(max_items) if max_items > 0 else df
    out.write.json(path)


def accuracy_report(df: DataFrame, reward: str = "reward") -> DataFrame:
    return df.agg(F.format_string("%.4f", F.avg(F.col(reward).cast("double"))).alias("value"))


def write_accuracy_report(df: DataFrame, path: str, reward: str = "reward") -> None:
    """One line of text: the mean reward with four decimals."""
    accuracy_report(df, reward).coalesce(1).write.text(path)


def write_dataset_config(config: DataFrame, path: str) -> None:
    """Side-car JSON of the one-row configuration of a data set."""
    config.coalesce(1).write.json(path)


def log_metrics(metrics: DataFrame, path: str, backends: Sequence[str] = ("table",)) -> None:
    """Append metric rows of finished steps to the metric table, and print one line per step for the console."""
    unknown = [b for b in backends if b not in METRIC_BACKENDS]
    if unknown:
        raise ValueError(f"unsupported metric backends {unknown}")
    if "table" in backends:
        metrics.write.mode("append").partitionBy("run").parquet(path)
    if "console" in backends:
        for row in metrics_line(metrics).select("line").toLocalIterator():
            print(row["line"])
