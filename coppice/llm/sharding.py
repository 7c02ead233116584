"""Weighted rendezvous sharding of records by a stable key.

Every (key, shard) pair has one hash; a record belongs to the shard whose weighted score ``-weight / ln(u)`` is
largest. Adding a shard only adds one more contender, so a record either stays or moves to the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_BUCKETS = 1024


def shard_score(key: Column, shard: Column, weight: Column) -> Column:
    """Score of one shard for one key; the hash is read as a number strictly between 0 and 1."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -weight / F.log(u)


def winner(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, shard) of the winning shard; equal scores go to the lower number."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    listed = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    scored = F.transform(listed, lambda s: F.struct(shard_score(key, s["shard"], s["weight"]).alias("score"), (-s["shard"]).alias("minus")))
    return F.array_max(scored)


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], new_weight: float = 1.0,
                  shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Adds ``shard`` and ``grown``, the shard once a further one of ``new_weight`` joins. Row-local, no shuffle.

    The key is cast to text; a null key counts as empty text, so all null keys share a shard. Equal keys share
    a shard by definition. An empty frame stays empty. Columns named like the two new ones are replaced.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    best, extra = "__best_shard", "__new_score"
    scored = df.withColumn(best, winner(text, weights)).withColumn(
        extra, shard_score(text, F.lit(len(weights)), F.lit(float(new_weight))))
    current = -F.col(best)["minus"]
    return (scored.withColumn(shard, current)
            .withColumn(grown, F.when(F.col(extra) > F.col(best)["score"], F.lit(len(weights))).otherwise(current))
            .drop(best, extra))


def number_slots(rows: DataFrame, shard: str, identity: Sequence[str], slot: str = "slot",
                 buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Gapless positions from 0 inside every shard, for a frame of narrow rows.

    Rows equal in all ``identity`` columns are counted before anything is shuffled and expanded at the end, so
    neither repeated rows nor a hot key meet in one task. A shard is cut into ``buckets`` hash ranges: ranks are
    taken inside a range and start at the number of rows in the ranges before it.
    """
    counted = rows.groupBy(shard, *identity).agg(F.count(F.lit(1)).alias("__copies"))
    spread = counted.withColumn("__order", F.xxhash64(*identity))
    spread = spread.withColumn("__group", F.struct(F.col(shard).alias("s"), F.pmod("__order", F.lit(buckets)).alias("b")))
    before = Window.partitionBy(F.col("__group")["s"]).orderBy(F.col("__group")["b"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (spread.groupBy("__group").agg(F.sum("__copies").alias("__rows"))
               .select(F.col("__group").alias("__of"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")))
    inside = Window.partitionBy("__group").orderBy("__order", *identity).rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.withColumn("__first", F.coalesce(F.sum("__copies").over(inside), F.lit(0)))
    placed = ranked.join(offsets, F.col("__group") == F.col("__of"))
    start = F.col("__offset") + F.col("__first")
    slots = placed.withColumn(slot, F.explode(F.sequence(start, start + F.col("__copies") - 1)))
    return slots.select(shard, *identity, slot)
