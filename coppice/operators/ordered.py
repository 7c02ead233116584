"""Positions, running totals and linear recurrences over ordered groups.

A plain ordered window sends a whole group (or, without keys, the whole table) through one task. These
operators split every ordered group into buckets, work inside buckets in parallel, and combine one summary
row per bucket, so neither a global order nor a hot group is a single-task job. The results are exact
whatever the bucket sizes are; buckets only decide the balance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_ID_BUCKET = 1 << 20
HASH_PREFIX_DIGITS = 4


def seeded_key(seed: object, *parts: Column) -> Column:
    """Reproducible random sort key: md5 of the seed and the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_bucket(key: Column) -> Column:
    """Leading hex digits: evenly filled, and monotone in the md5 key."""
    return F.substring(key, 1, HASH_PREFIX_DIGITS)


def id_bucket(row_id: Column, width: int = ROWS_PER_ID_BUCKET) -> Column:
    return F.floor(row_id / F.lit(width))


def time_bucket(ts: Column, unit: str = "day") -> Column:
    return F.date_trunc(unit, ts)


def with_position(df: DataFrame, order_by: Sequence[Column], bucket: Column, keys: Sequence[str] = (),
                  name: str = "pos", total: str | None = None) -> DataFrame:
    """0-based position of each row in its group. ``bucket`` must be monotone in ``order_by``.

    ``total`` adds the group's row count, which the bucket sizes give for free.
    """
    keyed = _grouped(df, keys, bucket)
    sizes = keyed.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*[F.col("__group")[k] for k in keys])
    before = group.orderBy(F.col("__group")["__bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    counted = [F.sum("__n").over(group).alias(total)] if total else []
    offsets = sizes.select("__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), *counted)
    ranked = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("__group").orderBy(*order_by)))
    return (_with_summary(ranked, offsets).withColumn(name, F.col("__offset") + F.col("__rank") - 1)
            .drop("__group", "__rank", "__offset"))


def _grouped(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """``__group``: keys and bucket as one struct. It is never null, even when a key is, so one plain equality on it
    serves grouping, windowing and joining, and rows are shuffled once for all three."""
    return df.withColumn("__group", F.struct(*keys, bucket.alias("__bucket")))


def _with_summary(rows: DataFrame, summary: DataFrame) -> DataFrame:
    other = summary.withColumnRenamed("__group", "__other")
    return rows.join(other, F.col("__group") == F.col("__other")).drop("__other")


def running_total(df: DataFrame, value: Column, order_by: Sequence[Column], bucket: Column,
                  keys: Sequence[str] = (), name: str = "total", reverse: bool = False,
                  inclusive: bool = True) -> DataFrame:
    """Running sum over an ordered group, bucket by bucket. ``reverse`` sums from the row to the end."""
    keyed = _grouped(df, keys, bucket).withColumn("__value", value)
    sums = keyed.groupBy("__group").agg(F.sum("__value").alias("__sum"))
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    outer = Window.partitionBy(*[F.col("__group")[k] for k in keys]).orderBy(F.col("__group")["__bucket"])
    outer = outer.rowsBetween(1, last) if reverse else outer.rowsBetween(first, -1)
    carried = sums.select("__group", F.sum("__sum").over(outer).alias("__carry"))
    edge = 0 if inclusive else 1
    inner = Window.partitionBy("__group").orderBy(*order_by)
    inner = inner.rowsBetween(edge, last) if reverse else inner.rowsBetween(first, -edge)
    local = keyed.withColumn("__local", F.sum("__value").over(inner))
    zero = F.lit(0)
    return (_with_summary(local, carried)
            .withColumn(name, F.coalesce("__local", zero) + F.coalesce("__carry", zero))
            .drop("__group", "__value", "__local", "__carry"))


def linear_recurrence(df: DataFrame, keys: Sequence[str], pos: str, gain: Column, offset: Column, out: str, *,
                      reverse: bool = True, init: float = 0.0, block: int = 1024,
                      max_len: int | None = None) -> DataFrame:
    """Solve ``y = offset + gain * y_neighbour`` along each group and give every row its neighbour's ``y``.

    ``reverse`` runs from the last position to the first. Each ``block`` of positions folds to an affine
    map (gain, offset); the maps are chained the same way, ``block`` times fewer rows per level, until a
    group fits in one block. No task ever holds more than ``block`` rows of a group.
    ``max_len``: largest position + 1; measured with one small aggregate when not given.
    """
    frame = df.withColumn("__gain", gain.cast("double")).withColumn("__offset", offset.cast("double"))
    if max_len is None:
        top = df.agg(F.max(pos)).first()[0]
        max_len = 0 if top is None else int(top) + 1
    return _chain_blocks(frame, list(keys), pos, out, reverse, init, block, max_len).drop("__gain", "__offset")


_FOLD = """aggregate(__items,
  named_struct('y', 0D, 'm', 1D, 'seen', cast(array() as array<struct<y:double,m:double>>)),
  (s, x) -> named_struct('y', x.offset + x.gain * s.y, 'm', x.gain * s.m,
                         'seen', array_append(s.seen, named_struct('y', s.y, 'm', s.m))),
  s -> s.seen)"""
_SUMMARY = """aggregate(__items, named_struct('y', 0D, 'm', 1D),
  (s, x) -> named_struct('y', x.offset + x.gain * s.y, 'm', x.gain * s.m))"""


def _chain_blocks(frame, keys, pos, out, reverse, init, block, max_len):
    columns = frame.columns
    blocked = _grouped(frame, keys, F.floor(F.col(pos) / F.lit(block)))
    step = [F.col(pos).alias("p"), F.col("__gain").alias("gain"), F.col("__offset").alias("offset")]
    whole = F.struct(*step, F.struct(*[F.col(c) for c in columns]).alias("row"))
    folded = (blocked.groupBy("__group")
              .agg(F.sort_array(F.collect_list(whole), asc=not reverse).alias("__items"))
              .withColumn("__seen", F.expr(_FOLD)))
    if max_len <= block:
        fits = F.col("__group")["__bucket"] == 0
        folded = folded.withColumn("__in", F.when(fits, F.lit(float(init))).otherwise(
            F.raise_error(F.lit("a position is not below max_len")).cast("double")))
    else:
        summary = (blocked.groupBy("__group")
                   .agg(F.sort_array(F.collect_list(F.struct(*step)), asc=not reverse).alias("__items"))
                   .withColumn("__map", F.expr(_SUMMARY))
                   .select(*[F.col("__group")[k].alias(k) for k in keys], F.col("__group")["__bucket"].alias("__at"),
                           F.col("__group").alias("__from"), F.col("__map.m").alias("__gain"), F.col("__map.y").alias("__offset")))
        carried = _chain_blocks(summary, keys, "__at", "__in", reverse, init, block, -(-max_len // block))
        folded = _with_summary(folded, carried.select(F.col("__from").alias("__group"), "__in"))
    # outer: a block is never empty, and the plain form would repeat the fold in an inferred size filter
    rows = folded.select("__in", F.explode_outer(F.arrays_zip("__items", "__seen")).alias("z"))
    return rows.select(*[F.col(f"z.__items.row.{c}").alias(c) for c in columns],
                       (F.col("z.__seen.y") + F.col("z.__seen.m") * F.col("__in")).alias(out))
