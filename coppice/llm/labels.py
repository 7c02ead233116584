"""Labelled rows for the trained text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

#: Label rows up to which the label side is sent to every task (16 bytes each); beyond it both sides are shuffled.
SMALL_LABELS = 4_000_000


def with_label(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that have a non-null label, with it as ``label`` (a key labelled twice takes the larger)."""
    side = only(labels, key, label).toDF("__key", "label").where(F.col("label").isNotNull() & F.col("__key").isNotNull())
    side = side.groupBy("__key").agg(F.max(F.col("label").cast("int")).alias("label"))
    if labels.count() <= SMALL_LABELS:
        side = F.broadcast(side)
    return docs.join(side, F.col(key) == F.col("__key")).drop("__key")


def sampled_keys(docs: DataFrame, labels: DataFrame, label: str, size: int, key: str = "doc_id") -> DataFrame:
    """At most ``size`` labelled rows of ``docs``, those whose keys hash lowest; only keys are sorted."""
    keys = only(labels, key, label).toDF("__key", "__label").where("__label is not null").select("__key").distinct()
    known = keys.join(docs.select(F.col(key).alias("__of")), F.col("__key") == F.col("__of"), "left_semi")
    chosen = known.orderBy(F.xxhash64("__key"), "__key").limit(size)
    return with_label(docs.join(F.broadcast(chosen), F.col(key) == F.col("__key")).drop("__key"), labels, label, key)
