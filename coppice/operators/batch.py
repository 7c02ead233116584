"""Batch algebra on explicit row positions.

A batch is a DataFrame with a ``pos`` column (see ``ordered.with_position``). Sizes enter expressions as
scalar subqueries, so every operator stays lazy and nothing but one number is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import attach, one_row
from .ordered import hash_bucket, id_bucket, seeded_key, with_position

SLICES = 64
FOLD_CHUNK = 1024
TOTAL = "n_rows"


def batch_len(df: DataFrame) -> Column:
    """Row count as a scalar expression (0 for an empty frame)."""
    return one_row(df, F.count(F.lit(1)).alias("n"))["n"]


def _rows(df: DataFrame) -> Column:
    """The batch size: the ``n_rows`` column its positions came with, or a count."""
    return F.col(TOTAL) if TOTAL in df.columns else batch_len(df)


def _must(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("bigint"))


def divides(n: Column, k: int, what: str) -> Column:
    """``n`` itself, or an error when ``k`` does not divide it."""
    return _must(F.pmod(n, F.lit(k)) == 0, n, f"{what}: the number of rows is not divisible by {k}")


# ---------------------------------------------------------------- columns
def batch_select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def batch_pop(df: DataFrame, row_id: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(popped columns with the row id, the rest); unknown columns are an error."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"cannot pop {absent}")
    return df.select(row_id, *columns), df.drop(*columns)


def batch_rename(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def ragged_rows(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Rows whose arrays differ in length: empty for a consistent batch."""
    first = F.size(arrays[0])
    bad = None
    for name in arrays[1:]:
        part = F.size(name) != first
        bad = part if bad is None else bad | part
    return df.where(bad)


def columns_to_rows(df: DataFrame, keys: Sequence[str], arrays: Sequence[str], pos: str = "pos") -> DataFrame:
    """Parallel arrays to one row per element; arrays of different lengths are an error."""
    even = None
    for name in arrays[1:]:
        part = F.size(name) == F.size(arrays[0])
        even = part if even is None else even & part
    zipped = F.arrays_zip(*arrays)
    if even is not None:
        zipped = F.when(even, zipped).otherwise(
            F.from_json(F.raise_error(F.lit("ragged columns")).cast("string"), df.select(zipped).schema[0].dataType))
    return df.select(*keys, F.posexplode(zipped).alias(pos, "z")).select(
        *keys, pos, *[F.col(f"z.{a}").alias(a) for a in arrays])


def rows_to_columns(df: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a record to parallel arrays in position order. The group is one record: it must fit a cell."""
    items = F.sort_array(F.collect_list(F.struct(pos, *columns))).alias("__items")
    return df.groupBy(*keys).agg(items).select(*keys, *[F.col("__items")[c].alias(c) for c in columns])


def batch_bytes(df: DataFrame, numeric_widths: dict[str, int], object_columns: Sequence[str]) -> DataFrame:
    """Bytes of numeric arrays (elements x width) and of object columns (UTF-8 length)."""
    def total(parts):
        out = F.lit(0)
        for p in parts:
            out = out + F.coalesce(F.sum(p), F.lit(0))
        return out
    return df.agg(total([F.size(c) * w for c, w in numeric_widths.items()]).alias("numeric_bytes"),
                  total([F.octet_length(c) for c in object_columns]).alias("object_bytes"))


# ---------------------------------------------------------------- merge
def batch_conflicts(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """(row id, column) pairs where both batches hold a shared column with different values."""
    shared = [c for c in left.columns if c in right.columns and c != row_id]
    tagged = right.select(row_id, *[F.col(c).alias(f"__o_{c}") for c in shared])
    joined = attach(left.select(row_id, *shared), tagged, [row_id])
    differing = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__o_{c}")), F.lit(c)) for c in shared]),
                         lambda x: x.isNotNull())
    return joined.select(row_id, F.explode(differing).alias("column"))


def batch_union(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Column-wise merge; a shared column that differs is an error at run time."""
    shared = [c for c in left.columns if c in right.columns and c != row_id]
    tagged = right.withColumnsRenamed({c: f"__o_{c}" for c in shared})
    joined = attach(left, tagged, [row_id])
    for c in shared:
        joined = joined.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__o_{c}")), F.col(c)).otherwise(
            F.raise_error(F.lit(f"column {c} differs between the batches")).cast(left.schema[c].dataType)))
    return joined.drop(*[f"__o_{c}" for c in shared])


def batch_concat(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for other in batches[1:]:
        out = out.unionByName(other)
    return out


# ---------------------------------------------------------------- order
def batch_reorder(df: DataFrame, permutation: DataFrame, pos: str = "pos") -> DataFrame:
    """``permutation`` (new_pos, old_pos): row old_pos moves to new_pos."""
    moved = permutation.select(F.col("old_pos").alias(pos), "new_pos")
    return attach(df, moved, [pos]).drop(pos).withColumnRenamed("new_pos", pos)


def reverse_index(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("old_pos").alias("new_pos"), F.col("new_pos").alias("old_pos"))


def shuffle_rows(df: DataFrame, row_id: str, seed: object = None, epoch: object = 0, pos: str = "pos") -> DataFrame:
    """Seeded reproducible order, or the id order when no seed is given."""
    if seed is None:
        return with_position(df, [F.col(row_id)], id_bucket(F.col(row_id)), name=pos, total=TOTAL)
    keyed = df.withColumn("__key", seeded_key(f"{seed}|{epoch}", F.col(row_id)))
    return with_position(keyed, [F.col("__key"), F.col(row_id)], hash_bucket(F.col("__key")), name=pos,
                         total=TOTAL).drop("__key")


def sample_generations(df: DataFrame, n: int, step: int, seed: object = 42, key: str = "input",
                       columns: Sequence[str] = ("input", "output", "score")) -> DataFrame:
    """One wide row per step with the first ``n`` samples of a seeded order over the inputs."""
    picked = (df.withColumn("__key", seeded_key(seed, F.col(key))).orderBy("__key", key, *columns).limit(n)
              .agg(F.sort_array(F.collect_list(F.struct("__key", key, *[F.col(c).alias(f"c_{c}") for c in columns])))
                   .alias("rows")))
    wide = [F.get("rows", F.lit(i))[f"c_{c}"].alias(f"{c}_{i + 1}") for i in range(n) for c in columns]
    return picked.select(F.lit(step).alias("step"), *wide)


# ---------------------------------------------------------------- slicing into batches
def make_batches(df: DataFrame, batch_size: int | None, drop_last: bool = True, pos: str = "pos") -> DataFrame:
    """``batch_id`` by position; ``batch_size=None`` is one whole batch."""
    if batch_size is None:
        return df.withColumn("batch_id", F.lit(0).cast("bigint"))
    out = df.withColumn("batch_id", F.floor(F.col(pos) / F.lit(batch_size)))
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(_rows(df) / F.lit(batch_size))).drop(TOTAL)
    return out


def total_steps(df: DataFrame, batch_size: int, epochs: int, override: int | None = None) -> DataFrame:
    steps = F.floor(F.count(F.lit(1)) / F.lit(batch_size)) * F.lit(epochs)
    return df.agg((F.lit(override) if override is not None else steps).cast("bigint").alias("total_steps"))


def resume_batches(batched: DataFrame, last_done: int) -> DataFrame:
    return batched.where(F.col("batch_id") > last_done)


def shard_rows(shuffled: DataFrame, world_size: int, pos: str = "pos") -> DataFrame:
    """Deal rows to ranks in turn; the tail that does not fill every rank is dropped."""
    whole = F.floor(_rows(shuffled) / F.lit(world_size)) * F.lit(world_size)
    return shuffled.where(F.col(pos) < whole).withColumn("rank", F.pmod(F.col(pos), F.lit(world_size))).drop(TOTAL)


def mini_batches(df: DataFrame, row_id: str, mini_batch_size: int, epochs: int, seed: object = None,
                 pos: str = "pos") -> DataFrame:
    """Every epoch over the batch in mini-batches, in batch order or reshuffled per epoch with a seed."""
    n = divides(_rows(df), mini_batch_size, "mini-batches")
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is not None:
        out = out.drop(pos).withColumn("__key", seeded_key(seed, F.col("epoch"), F.col(row_id)))
        out = with_position(out, [F.col("__key"), F.col(row_id)], hash_bucket(F.col("__key")), keys=["epoch"],
                            name=pos).drop("__key")
    per_epoch = n / F.lit(mini_batch_size)
    step = F.col("epoch") * per_epoch + F.floor(F.col(pos) / F.lit(mini_batch_size))
    return out.withColumn("mini_batch", step.cast("bigint"))


def batch_slice(df: DataFrame, start: int | None = None, stop: int | None = None, pos: str = "pos") -> DataFrame:
    """Rows by position; negative bounds count from the end."""
    def edge(value):
        return F.lit(value) if value >= 0 else _rows(df) + F.lit(value)
    out = df
    if start is not None:
        out = out.where(F.col(pos) >= edge(start))
    if stop is not None:
        out = out.where(F.col(pos) < edge(stop))
    return out.drop(TOTAL)


def batch_chunk(df: DataFrame, chunks: int, pos: str = "pos") -> DataFrame:
    """Equal contiguous chunks; the length must divide."""
    size = divides(_rows(df), chunks, "chunks") / F.lit(chunks)
    return df.withColumn("chunk", F.floor(F.col(pos) / size))


def batch_repeat(df: DataFrame, times: int, interleave: bool = True, pos: str = "pos") -> DataFrame:
    """Each row ``times`` times next to itself, or the whole batch ``times`` times in a row."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        placed = F.col(pos) * F.lit(times) + F.col("copy")
    else:
        placed = F.col("copy") * _rows(df) + F.col(pos)
    return copies.withColumn(pos, placed).drop(TOTAL)


def pad_to_divisor(df: DataFrame, divisor: int, pos: str = "pos") -> DataFrame:
    """Append rows copied cyclically from the head until the length divides; copies carry ``is_pad``."""
    n = _rows(df)
    pad = F.pmod(F.lit(divisor) - F.pmod(n, F.lit(divisor)), F.lit(divisor))
    rounds = F.ceil((pad - F.col(pos)) / n)
    head = (df.where(F.col(pos) < pad)
            .withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), rounds - 1)))
            .withColumn(pos, n + F.col("__copy") * n + F.col(pos)).drop("__copy").withColumn("is_pad", F.lit(1)))
    return df.withColumn("is_pad", F.lit(0)).unionByName(head).drop(TOTAL)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_pad") == 0).drop("is_pad")


def fold_batch(df: DataFrame, new_size: int, columns: Sequence[str], pos: str = "pos", largest: int | None = None) -> DataFrame:
    """[b] -> [new_size, b/new_size]: a row per fold with all its rows in order, so one cell holds b/new_size rows.

    With ``largest`` a row per (fold, chunk) instead, each with at most that many rows of the fold; chunks follow each
    other in their fold. Whole folds are put together from sorted chunks, so that no task sorts a fold.
    """
    width = divides(_rows(df), new_size, "fold") / F.lit(new_size)
    placed = df.withColumn("fold", F.floor(F.col(pos) / width))
    placed = placed.withColumn("chunk", F.floor((F.col(pos) - F.col("fold") * width) / F.lit(largest or FOLD_CHUNK)))
    chunks = placed.groupBy("fold", "chunk").agg(F.sort_array(F.collect_list(F.struct(pos, *columns))).alias("rows"))
    if largest is not None:
        return chunks
    in_order = F.sort_array(F.collect_list(F.struct("chunk", "rows")))
    return chunks.groupBy("fold").agg(F.flatten(F.transform(in_order, lambda c: c["rows"])).alias("rows"))


def unfold_batch(folded: DataFrame, columns: Sequence[str], pos: str = "pos") -> DataFrame:
    return folded.select(F.explode("rows").alias("r")).select(f"r.{pos}", *[f"r.{c}" for c in columns])


def batch_size_check(config: DataFrame, total: Column, parts: Column) -> DataFrame:
    """Configuration rows with the divisibility verdict of their batch size."""
    return config.withColumn("divides", (F.pmod(total, parts) == 0).cast("int"))


def fanout_rollouts(prompts: DataFrame, responses: DataFrame, uid: str, n: int, sample: str = "sample") -> DataFrame:
    """Every prompt ``n`` times, each copy with its own sampled response.

    The copies are made by the join with the responses 0 to ``n - 1``: copies made before it would be sent around, and
    Spark sizes a side by the rows it had before they were. Neither side is broadcast, whatever its estimate.
    """
    at = F.col(sample)
    numbered = responses.where((at >= 0) & (at < n) & (at == at.cast("int"))).withColumn(sample, at.cast("int"))
    columns = [*prompts.columns, sample, *[c for c in responses.columns if c not in (uid, sample)]]
    return attach(prompts.hint("merge"), numbered, [uid]).select(*columns)


def sample_per_source(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of every source in the order of ``order``.

    Ranked inside salted slices of a source first, so a hot source is cut to ``n`` rows per slice before
    its final ranking.
    """
    slices = df.withColumn("__slice", F.pmod(F.xxhash64(order), F.lit(SLICES)))
    local = Window.partitionBy(source, "__slice").orderBy(order)
    final = Window.partitionBy(source).orderBy(order)
    return (slices.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= n)
            .withColumn("__r", F.row_number().over(final)).where(F.col("__r") <= n).drop("__slice", "__r"))
