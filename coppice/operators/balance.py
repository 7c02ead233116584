"""Length balancing: exact differencing inside bounded batches, and a corpus-wide deal.

``balance_partitions``, ``balance_greedy`` and ``micro_batches`` work on training batches, whose size is
``batch_size`` by construction (batch ids come from positions), so a pandas group is never larger than a
batch. ``balance_snake`` balances a whole corpus with one distributed position and arithmetic.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import id_bucket, with_position

# The functions below travel with the task, so Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Merge(NamedTuple):
    """A node of the merge history: which part of each child makes each part."""

    left: int
    right: int
    crossing: list[int]


def differencing_split(lengths: Sequence[int], k: int, equal_size: bool) -> list[list[int]]:
    """Multi-way largest differencing: ``k`` sorted parts of row indices, numbered by their smallest row.

    Only the ``k`` part sums of a node and how far they lie apart are kept while merging; the rows of the parts are read
    off the merge history at the end. Two nodes merge with opposite order of their sums. Of nodes with equal spread the
    one made first is taken. ``equal_size`` starts from tuples of ``k`` neighbours in descending length, one row a part,
    so that every merge adds equally many rows to every part; otherwise a row starts alone, next to k - 1 empty parts.
    """
    n = len(lengths)
    if n < k:
        raise ValueError(f"{n} rows cannot fill {k} parts")
    if equal_size and n % k:
        raise ValueError(f"{n} rows do not divide into {k} equal parts")
    longest_first = np.argsort(-np.asarray(lengths, dtype=np.int64), kind="stable")
    width = k if equal_size else 1
    leaves = [longest_first[at : at + width].tolist() for at in range(0, n, width)]
    sums = {node: sorted([lengths[i] for i in rows] + [0] * (k - width), reverse=True) for node, rows in enumerate(leaves)}
    queue = [(low[-1] - low[0], node) for node, low in sums.items()]
    heapq.heapify(queue)
    history: list[_Merge] = []
    while len(queue) > 1:
        (_, one), (_, two) = heapq.heappop(queue), heapq.heappop(queue)
        added = [x + y for x, y in zip(sums.pop(one), reversed(sums.pop(two)), strict=True)]
        crossing = sorted(range(k), key=added.__getitem__, reverse=True)
        node = len(leaves) + len(history)
        history.append(_Merge(one, two, crossing))
        sums[node] = [added[c] for c in crossing]
        heapq.heappush(queue, (sums[node][-1] - sums[node][0], node))
    part_of = np.zeros(n, dtype=np.int64)
    places = {queue[0][1]: list(range(k))}  # of a node: the final part of each of its parts
    for node in range(len(leaves) + len(history) - 1, -1, -1):
        goes = places.pop(node)
        if node < len(leaves):
            part_of[leaves[node]] = goes[:width]
            continue
        left, right, crossing = history[node - len(leaves)]
        ahead = [0] * k
        for final, c in zip(goes, crossing, strict=True):
            ahead[c] = final
        places[left], places[right] = ahead, ahead[::-1]
    parts = [np.flatnonzero(part_of == p).tolist() for p in range(k)]
    if not all(parts):
        raise ValueError("a part is empty")
    return sorted(parts)


def greedy_split(lengths: Sequence[int], k: int, equal_size: bool) -> list[list[int]]:
    """Rows in input order, each to the part with the least length so far (the first of several).

    ``equal_size`` allows only parts that have room among n / k rows and hold no more rows than any other.
    """
    if equal_size and len(lengths) % k:
        raise ValueError("parts are not of equal size")
    held, rows = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    part_of = np.zeros(len(lengths), dtype=np.int64)
    for i, length in enumerate(lengths):
        allowed = np.flatnonzero(rows == rows.min()) if equal_size else np.arange(k)
        part_of[i] = chosen = allowed[held[allowed].argmin()]
        held[chosen] += length
        rows[chosen] += 1
    return [np.flatnonzero(part_of == p).tolist() for p in range(k)]


def _per_batch(batched: DataFrame, split, pos: str, length: str) -> DataFrame:
    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        part = [0] * len(rows)
        for number, members in enumerate(split(rows["length"].tolist())):
            for i in members:
                part[i] = number
        return rows[["batch_id", "pos"]].assign(part=part)

    slim = batched.select("batch_id", F.col(pos).cast("bigint").alias("pos"), F.col(length).cast("bigint").alias("length"))
    return slim.groupBy("batch_id").applyInPandas(assign, "batch_id bigint, pos bigint, part int")


def balance_partitions(batched: DataFrame, k: int, equal_size: bool = True, pos: str = "pos",
                       length: str = "length") -> DataFrame:
    """(batch_id, pos, part) of the differencing split of every batch.

    A last batch of fewer than ``k`` rows gets a part per row; one whose size ``k`` does not divide is balanced by length
    alone.
    """
    def split(lengths):
        return differencing_split(lengths, min(k, len(lengths)), equal_size and len(lengths) % k == 0)

    return _per_batch(batched, split, pos, length)


def balance_greedy(batched: DataFrame, k: int, equal_size: bool = False, pos: str = "pos",
                   length: str = "length") -> DataFrame:
    return _per_batch(batched, lambda lengths: greedy_split(lengths, k, equal_size), pos, length)


def micro_batches(batched: DataFrame, max_tokens: int, padded_length: int, pos: str = "pos",
                  length: str = "length", least: int = 1) -> DataFrame:
    """Token-budget micro-batches: as many as the budget asks for, balanced by differencing.

    ``least`` is the largest number that another rank needs, as all ranks take equally many; a batch with fewer rows
    than that is an error.
    """
    if max_tokens < padded_length:
        raise ValueError("the token budget is smaller than the padded sequence length")

    def split(lengths):
        wanted = max(least, -(-sum(lengths) // max_tokens))
        if wanted > len(lengths):
            raise ValueError(f"{len(lengths)} rows cannot fill {wanted} micro-batches")
        return differencing_split(lengths, wanted, equal_size=False)

    return _per_batch(batched, split, pos, length)


def balance_snake(df: DataFrame, row_id: str, length: Column, k: int) -> DataFrame:
    """Longest first, dealt to ``k`` parts back and forth: the whole-corpus form of length balancing."""
    keyed = df.withColumn("__len", length)
    placed = with_position(keyed, [F.col("__len").desc(), F.col(row_id)],
                           F.struct((-F.col("__len")).alias("n"), id_bucket(F.col(row_id)).alias("b")), name="rank_pos")
    turn = F.floor(F.col("rank_pos") / F.lit(k))
    seat = F.pmod(F.col("rank_pos"), F.lit(k))
    part = F.when(F.pmod(turn, F.lit(2)) == 0, seat).otherwise(F.lit(k - 1) - seat)
    return placed.withColumn("part", part).drop("__len")


def cover_violations(expected: DataFrame, assigned: DataFrame, row_id: str) -> DataFrame:
    """Rows not assigned exactly once: (row id, expected, assigned)."""
    tally = (expected.select(row_id, F.lit(1).alias("e"), F.lit(0).alias("a"))
             .unionByName(assigned.select(row_id, F.lit(0).alias("e"), F.lit(1).alias("a")))
             .groupBy(row_id).agg(F.sum("e").alias("expected"), F.sum("a").alias("assigned")))
    return tally.where(F.col("expected") != F.col("assigned"))


def uneven_parts(assigned: DataFrame, part: str = "part") -> DataFrame:
    """Parts with their sizes when the sizes differ; empty for an equal split."""
    sizes = assigned.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.agg(F.struct(F.min("n").alias("lo"), F.max("n").alias("hi")).alias("s")).scalar()
    return sizes.where(stats["lo"] != stats["hi"])
