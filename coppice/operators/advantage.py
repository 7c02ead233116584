"""Advantages and returns of rollouts in long form (one row per token).

Group statistics (GRPO, RLOO, ReMax) are aggregates joined back on their keys; token recurrences (GAE,
REINFORCE++, ReMax returns) are blocked scans, so one very long sequence or one very large group is still
spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import kl_penalty
from .joins import attach, with_group_stats
from .metrics import group_accuracy, masked_mean, masked_whiten
from .ordered import linear_recurrence, running_total


def group_stat_join(scored: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    """Each sample with the mean, spread and size of its group."""
    return attach(scored, group_accuracy(scored, group, score), group)


def _spread_over_tokens(tokens, per_seq, seq, mask):
    out = attach(tokens, per_seq.select(*seq, "__adv"), seq)
    return (out.withColumn("advantage", F.col("__adv") * F.col(mask))
            .withColumn("returns", F.col("advantage")).drop("__adv"))


def _sequence_scores(tokens, group, seq, reward):
    return tokens.groupBy(*dict.fromkeys([*group, *seq])).agg(F.sum(reward).alias("score"))


def grpo(tokens: DataFrame, group: Sequence[str], seq: Sequence[str], reward: str = "reward",
         mask: str = "mask", eps: float = 1e-6) -> DataFrame:
    """Group-normalised outcome advantage, repeated on every valid token."""
    scored = group_stat_join(_sequence_scores(tokens, group, seq, reward), group)
    per_seq = scored.withColumn("__adv", (F.col("score") - F.col("mean")) / (F.col("std") + eps))
    return _spread_over_tokens(tokens, per_seq, seq, mask)


def rloo(tokens: DataFrame, group: Sequence[str], seq: Sequence[str], reward: str = "reward",
         mask: str = "mask") -> DataFrame:
    """Leave-one-out outcome advantage; a single sample keeps its raw score."""
    scored = with_group_stats(_sequence_scores(tokens, group, seq, reward), group,
                              F.count("score").alias("n"), F.avg("score").alias("mean"))
    scale = F.col("n") / (F.col("n") - 1)
    per_seq = scored.withColumn("__adv", F.when(F.col("n") > 1, F.col("score") * scale - F.col("mean") * scale)
                                .otherwise(F.col("score")))
    return _spread_over_tokens(tokens, per_seq, seq, mask)


def gae(tokens: DataFrame, seq: Sequence[str], pos: str = "t", reward: str = "reward", value: str = "value",
        mask: str = "mask", gamma: float = 1.0, lam: float = 1.0, batch: Sequence[str] = (),
        max_len: int | None = None, block: int = 1024) -> DataFrame:
    """Generalised advantage; returns are taken before the advantages are whitened over the batch.

    With Z_t = gamma (1-lam) V_t + gamma lam (r_t + Z_{t+1}), the return at t is r_t + Z_{t+1}: a linear
    recurrence that needs no look-ahead column.
    """
    r, v = F.col(reward), F.col(value)
    scanned = linear_recurrence(tokens, seq, pos, F.lit(gamma * lam),
                                F.lit(gamma * (1 - lam)) * v + F.lit(gamma * lam) * r, "__next",
                                max_len=max_len, block=block)
    out = (scanned.withColumn("returns", r + F.col("__next"))
           .withColumn("advantage", F.col("returns") - v).drop("__next"))
    return masked_whiten(out, "advantage", mask, batch=batch)


def reinforce_pp(tokens: DataFrame, seq: Sequence[str], pos: str = "t", reward: str = "reward",
                 mask: str = "mask", gamma: float = 1.0, batch: Sequence[str] = (),
                 max_len: int | None = None, block: int = 1024) -> DataFrame:
    """Discounted return that restarts after a masked position; whitened, then masked."""
    m, r = F.col(mask).cast("double"), F.col(reward)
    scanned = linear_recurrence(tokens, seq, pos, F.lit(gamma) * m, F.lit(gamma) * m * r, "__next",
                                max_len=max_len, block=block)
    out = scanned.withColumn("returns", r + F.col("__next")).withColumn("advantage", F.col("returns"))
    white = masked_whiten(out, "advantage", mask, batch=batch)
    return white.withColumn("advantage", F.col("advantage") * m).drop("__next")


def remax(tokens: DataFrame, seq: Sequence[str], pos: str = "t", reward: str = "reward", mask: str = "mask",
          baseline: str = "baseline", bucket: Column | None = None) -> DataFrame:
    """Reward to go (undiscounted, masked) minus the greedy baseline of the prompt."""
    m = F.col(mask)
    out = running_total(tokens, F.col(reward) * m, [F.col(pos)],
                        F.floor(F.col(pos) / 4096) if bucket is None else bucket,
                        keys=seq, name="returns", reverse=True)
    return out.withColumn("advantage", F.col("returns") - F.col(baseline) * m)


ESTIMATORS = {"gae": gae, "grpo": grpo, "reinforce_plus_plus": reinforce_pp, "remax": remax, "rloo": rloo}
USES_VALUES = {"gae"}


def advantage(tokens: DataFrame, estimator: str, seq: Sequence[str], group: Sequence[str] = (),
              gamma: float = 1.0, lam: float = 1.0, **options) -> DataFrame:
    """Advantages by estimator name."""
    if estimator not in ESTIMATORS:
        raise NotImplementedError(f"unknown advantage estimator {estimator!r}")
    if estimator in ("grpo", "rloo"):
        return ESTIMATORS[estimator](tokens, group, seq, **options)
    if estimator == "gae":
        return gae(tokens, seq, gamma=gamma, lam=lam, **options)
    if estimator == "reinforce_plus_plus":
        return reinforce_pp(tokens, seq, gamma=gamma, **options)
    return remax(tokens, seq, **options)


def token_rewards(tokens: DataFrame, beta: Column | float, kind: str = "kl", has_reference: bool = True) -> DataFrame:
    """Reward after the KL penalty: score - beta * kld * mask; without a reference policy there is none."""
    if has_reference:
        kld = kl_penalty(F.col("old_lp"), F.col("ref_lp"), kind) * F.col("mask")
        scale = beta if isinstance(beta, Column) else F.lit(beta)
    else:
        kld, scale = F.lit(0.0), F.lit(0.0)
    return tokens.withColumn("kld", kld).withColumn("reward", F.col("score") - scale * F.col("kld"))


def batch_kl(penalised: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Mean over sequences of the masked mean KL of a sequence."""
    per_seq = penalised.groupBy(*seq).agg(masked_mean(F.col("kld"), F.col("mask")).alias("kl"))
    return per_seq.agg(F.avg("kl").alias("current_kl"), F.count(F.lit(1)).alias("batch_size"))


def kl_controller(steps: DataFrame, run: Sequence[str], pos: str, kind: str, init: float, target: float = 1.0,
                  horizon: float = 1.0, max_len: int | None = None) -> DataFrame:
    """KL coefficient before and after every step of every run, steps in order of ``pos``."""
    if kind == "fixed":
        return steps.withColumn("beta", F.lit(float(init))).withColumn("beta_next", F.lit(float(init)))
    if kind != "adaptive":
        raise ValueError(f"unknown KL controller {kind!r}")
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    error = F.greatest(F.least(F.col("kl") / F.lit(target) - 1, F.lit(0.2)), F.lit(-0.2))
    mult = 1 + error * F.col("n_steps") / F.lit(float(horizon))
    frame = steps.withColumn("__mult", mult)
    out = linear_recurrence(frame, run, pos, F.col("__mult"), F.lit(0.0), "beta", reverse=False, init=init,
                            max_len=max_len)
    return out.withColumn("beta_next", F.col("beta") * F.col("__mult")).drop("__mult")
