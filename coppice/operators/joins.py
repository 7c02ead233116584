"""Equi-join helpers shared by the operators.

Group statistics are always a map-side-combined ``groupBy`` joined back on the key, never a window over the
group: a window puts a whole group in one task, while the aggregate shrinks a hot group before the shuffle
and adaptive execution splits its side of the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``right``'s other columns to ``left`` on null-safe equality of ``keys``."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[F.col(c) for c in right.columns if c not in keys])
    condition = None
    for key in keys:
        part = F.col(key).eqNullSafe(F.col(f"__r_{key}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Every row plus the aggregates of its own group.

    The aggregate is exchanged once more for the join. That is cheap, as it is one row a group, and it is what lets
    adaptive execution split a hot group's rows: a join that reuses the aggregate's own partitioning cannot be split.
    """
    return attach(df, df.groupBy(*keys).agg(*aggregates), keys)


def one_row(df: DataFrame, *aggregates: Column) -> Column:
    """Whole-frame aggregates as one struct, usable inside an expression (scalar subquery, no join)."""
    return df.agg(F.struct(*aggregates).alias("stats")).scalar()
