"""Mixing a corpus to target weights by iterative proportional fitting.

Token totals are aggregated to cells of the marginals (source, language, topic). One factor per category is then
fitted in turn until every marginal of the factored cells meets its target shares, and each document is kept with a
probability in proportion to its cell's factor product. The largest probability is 1, so this is the largest
sample without repeats whose expected marginals are the targets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Topic by the kind of matter a document names; the most frequent kind wins, earlier kinds win ties.
TOPIC_PATTERNS = {
    "legal": r"(?i)licen[cs]e|copyright|warranty",
    "contact": r"[A-Za-z0-9]@[A-Za-z0-9]",
    "tabular": r"\s\|\s",
    "markup": r"[#*$%&]{3}",
}
NO_TOPIC = "general"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def topic_of(text: Column, patterns: Mapping[str, str] = TOPIC_PATTERNS) -> Column:
    """Most frequent kind of ``patterns`` in the whole text, or ``NO_TOPIC`` when none occurs."""
    kinds = list(patterns)
    scored = F.array(*[F.struct(F.regexp_count(text, F.lit(patterns[k])).alias("hits"), F.lit(-i).alias("rank"),
                                F.lit(k).alias("topic")) for i, k in enumerate(kinds)])
    best = F.array_max(scored)
    return F.when(best["hits"] > 0, best["topic"]).otherwise(F.lit(NO_TOPIC))


def tempered_shares(cells: DataFrame, dim: str, temperature: float) -> DataFrame:
    """Target shares of a dimension: its token shares to the power ``temperature``, normalised."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).withColumn("p", F.pow(F.col("t").cast("double"), F.lit(temperature)))
    total = sums.agg(F.struct(F.sum("p").alias("p")).alias("s")).scalar()
    return sums.select(dim, (F.col("p") / total["p"]).alias("target"))


def fit_factors(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = 1e-6, max_rounds: int = 500) -> dict[str, DataFrame]:
    """One factor table (dim, factor) per dimension so that the cells' marginals meet ``targets``.

    Each half step is one small aggregate over the cells. It ends once no factor of a whole round changes by more
    than ``tolerance``; targets that no weighting can meet raise an error after ``max_rounds``.
    """
    dims = list(targets)
    factors = {d: written(targets[d].select(d, "target", F.lit(1.0).alias("factor")), "mix-factor") for d in dims}
    for _ in range(max_rounds):
        moves = []
        for dim in dims:
            others = cells.withColumn("__w", F.col("tokens").cast("double"))
            for d in dims:
                if d != dim:
                    others = others.join(factors[d].select(d, F.col("factor").alias(f"__{d}")), d).withColumn("__w", F.col("__w") * F.col(f"__{d}"))
            sums = others.groupBy(dim).agg(F.sum("__w").alias("__sum"))
            new = (factors[dim].join(sums, dim)
                   .select(dim, "target", (F.col("target") / F.col("__sum")).alias("factor"), F.col("factor").alias("__old")))
            new = written(new, "mix-factor")
            moves.append(new.select(F.abs(F.col("factor") / F.col("__old") - 1).alias("move")))
            factors[dim] = new.drop("__old")
        change = reduce(DataFrame.unionAll, moves).agg(F.max("move")).first()[0]
        if change <= tolerance:
            return factors
    raise ValueError(f"the targets cannot be met: factors still move by {change}")


def mix(df: DataFrame, key: str, text: str, dims: Sequence[str], temperature: float = 0.9, seed: str = "mix",
        targets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Every row with ``tokens``, ``probability`` (0 to 1) and ``sampled``.

    ``dims`` name the marginal columns; null is a category of its own. ``targets`` gives shares by dimension as
    (dim, target), with null written as ``'\\x00null'``; a category without a target is an error, and so is a
    target without tokens. Without ``targets`` the shares are tempered token shares. A row counts its tokens plus
    one, so empty texts have weight too. The draw is a hash of seed and key: repeated keys share it, and it does
    not depend on row order or partitioning. New columns replace same-named ones; an empty frame stays empty.
    """
    fresh = {"__k": F.coalesce(F.col(key).cast("string"), F.lit("")),
             "__tokens": token_count(F.coalesce(F.col(text), F.lit(""))).cast("long")}
    named = {f"__d{i}": F.coalesce(F.col(d).cast("string"), F.lit("\x00null")) for i, d in enumerate(dims)}
    rows = df.withColumns({**fresh, **named})
    cells = written(rows.groupBy(*named).agg(F.sum(F.col("__tokens") + 1).alias("tokens")), "mix-cells")
    if cells.isEmpty():
        return (df.withColumn("tokens", F.lit(0).cast("long")).withColumn("probability", F.lit(0.0)).withColumn("sampled", F.lit(False)))
    wanted = {}
    for i, d in enumerate(dims):
        wanted[f"__d{i}"] = (targets[d].select(F.col(d).alias(f"__d{i}"), "target") if targets else tempered_shares(cells, f"__d{i}", temperature))
    if targets:
        for name, shares in wanted.items():
            if not cells.select(name).distinct().join(shares, name, "full_outer").where(
                    F.col("target").isNull() | (F.col("target") <= 0)).isEmpty() or not shares.join(cells, name, "left_anti").isEmpty():
                raise ValueError("targets and categories differ")
    factors = fit_factors(cells, wanted)
    weighted = cells
    product = F.lit(1.0)
    for name, table in factors.items():
        weighted = weighted.join(table.select(name, F.col("factor").alias(f"{name}f")), name)
        product = product * F.col(f"{name}f")
    weighted = written(weighted.select(*[F.col(n).alias(f"{n}k") for n in named], product.alias("__m")), "mix-weights")
    top = weighted.agg(F.struct(F.max("__m").alias("m")).alias("s")).scalar()
    condition = F.lit(True)
    for name in named:
        condition = condition & (F.col(name) == F.col(f"{name}k"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("__k"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    out = rows.join(weighted, condition).withColumn("tokens", F.col("__tokens")).withColumn("probability", F.col("__m") / top["m"])
    return out.withColumn("sampled", drawn < F.col("probability")).select(
        *[c for c in df.columns if c.lower() not in ("tokens", "probability", "sampled")], "tokens", "probability", "sampled")
