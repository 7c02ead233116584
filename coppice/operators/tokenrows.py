"""Token-level operators over rollouts in long form: losses, masks, positions, outcome placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import losses as L
from .joins import attach
from .metrics import masked_mean, to_metric_rows
from .ordered import running_total

ROWS_PER_BUCKET = 4096


def position_bucket(pos: str) -> Column:
    return F.floor(F.col(pos) / ROWS_PER_BUCKET)


def kl_shaped_reward(score: Column, old_logprob: Column, ref_logprob: Column, kl_ratio: float) -> Column:
    return score - (old_logprob - ref_logprob) * F.lit(kl_ratio)


def policy_loss(tokens: DataFrame, seq: Sequence[str], clip: float, kl_kind: str | None = None) -> DataFrame:
    """Per-sequence masked means of the clipped surrogate, clip flag, KL estimate, entropy and KL loss.

    Needs old_lp, lp, advantage, mask; entropy and ref_lp are used when present.
    """
    parts = L.policy_objective(F.col("old_lp"), F.col("lp"), F.col("advantage"), clip)
    mask = F.col("mask")
    aggregates = [masked_mean(parts["loss"], mask).alias("pg_loss"),
                  masked_mean(parts["clipped"], mask).alias("pg_clipfrac"),
                  masked_mean(parts["kl"], mask).alias("ppo_kl")]
    if "entropy" in tokens.columns:
        aggregates.append(masked_mean(F.col("entropy"), mask).alias("entropy_loss"))
    if kl_kind:
        penalty = L.kl_penalty(F.col("lp"), F.col("ref_lp"), kl_kind)
        aggregates.append(masked_mean(penalty, mask).alias("kl_loss"))
    return tokens.groupBy(*seq).agg(*aggregates)


def mask_by_kl(per_seq: DataFrame, threshold: float, loss: str = "loss", kl: str = "kl_loss") -> DataFrame:
    """Zero the loss of sequences at or over the KL threshold (only a positive threshold masks).

    A sequence with an empty mask has neither loss nor KL: it counts as kept, with a loss of zero.
    """
    filled = per_seq.withColumn(loss, F.coalesce(F.col(loss), F.lit(0.0)))
    if threshold <= 0:
        return filled.withColumn("kept", F.lit(1.0))
    keep = F.when(F.col(kl) >= threshold, 0.0).otherwise(1.0)
    return filled.withColumn("kept", keep).withColumn(loss, F.col(loss) * F.col("kept"))


def policy_diagnostics(per_seq: DataFrame, entropy_coeff: float, kl_coef: float, kl_threshold: float = 0.0) -> DataFrame:
    """Actor metrics of one update: the loss is always reduced over sequences, with or without a KL term."""
    loss = F.col("pg_loss") - F.col("entropy_loss") * F.lit(entropy_coeff)
    if "kl_loss" in per_seq.columns:
        loss = loss + F.col("kl_loss") * F.lit(kl_coef)
    frame = per_seq.withColumn("loss", loss)
    names = ["entropy_loss", "pg_loss", "pg_clipfrac", "ppo_kl"]
    aggregates = [F.avg("loss").alias("actor/policy_loss")]
    if "kl_loss" in per_seq.columns:
        frame = mask_by_kl(frame, kl_threshold)
        names.append("kl_loss")
        aggregates.append(F.lit(kl_coef).alias("actor/kl_coef"))
        if kl_threshold > 0:
            aggregates.append((1 - F.avg("kept")).alias("actor/kl_masked_out_ratio"))
    aggregates += [F.avg(n).alias(f"actor/{n}") for n in names]
    return to_metric_rows(frame.agg(*aggregates))


def value_loss(tokens: DataFrame, clip: float, mask: str = "mask") -> DataFrame:
    parts = L.value_objective(F.col("vpred"), F.col("returns"), F.col("value"), clip)
    m = F.col(mask)
    return tokens.agg(masked_mean(parts["loss"], m).alias("vf_loss"), masked_mean(parts["clipped"], m).alias("vf_clipfrac"))


def shift_mask(tokens: DataFrame, seq: Sequence[str], pos: str, mask: str, first: int = 1) -> DataFrame:
    """``shifted_mask``: the mask of the previous position; the first position sees the prompt's last one."""
    before = tokens.select(*seq, (F.col(pos) + 1).alias(pos), F.col(mask).alias("__before"))
    return (attach(tokens, before, [*seq, pos], "left")
            .withColumn("shifted_mask", F.coalesce("__before", F.lit(first))).drop("__before"))


def critic_diagnostics(tokens: DataFrame, clip: float) -> DataFrame:
    """Critic metrics under the one-step shifted mask."""
    parts = L.value_objective(F.col("vpred"), F.col("returns"), F.col("value"), clip)
    m = F.col("shifted_mask")
    return to_metric_rows(tokens.agg(
        masked_mean(parts["loss"], m).alias("critic/vf_loss"),
        masked_mean(parts["clipped"], m).alias("critic/vf_clipfrac"),
        masked_mean(F.col("vpred"), m).alias("critic/vpred_mean")))


def response_logprobs(rows: DataFrame, seq: Sequence[str], pos: str, label: str, logits: str,
                      response_length: int) -> DataFrame:
    """Log-probabilities of the last ``response_length`` tokens: logits at t score the label at t + 1."""
    lengths = rows.groupBy(*seq).agg(F.count(F.lit(1)).alias("__n"))
    labels = rows.select(*seq, (F.col(pos) - 1).alias(pos), F.col(label).alias("__next"))
    tail = attach(rows, lengths, seq).where(
        (F.col(pos) >= F.col("__n") - response_length - 1) & (F.col(pos) < F.col("__n") - 1))
    scored = attach(tail, labels, [*seq, pos])
    return scored.withColumn("logprob", L.token_logprob(F.col(logits), F.col("__next"))).drop("__n", "__next")


def eos_mask(tokens: DataFrame, seq: Sequence[str], pos: str, is_eos: Column) -> DataFrame:
    """1 up to and including the first end-of-sequence token, 0 after it."""
    out = running_total(tokens, F.when(is_eos, 1).otherwise(0), [F.col(pos)], position_bucket(pos), keys=seq,
                        name="__ends", inclusive=False)
    return out.withColumn("eos_mask", F.when(F.col("__ends") == 0, 1).otherwise(0)).drop("__ends")


def position_ids(tokens: DataFrame, seq: Sequence[str], pos: str, mask: str) -> DataFrame:
    """Running count of valid tokens minus one: clipped at zero, and the variant that zeroes masked tokens."""
    out = running_total(tokens, F.col(mask), [F.col(pos)], position_bucket(pos), keys=seq, name="__seen")
    return (out.withColumn("position_id", F.greatest(F.col("__seen") - 1, F.lit(0)))
            .withColumn("masked_position", (F.col("__seen") - 1) * F.col(mask)).drop("__seen"))


def last_valid_token(tokens: DataFrame, seq: Sequence[str], pos: str, mask: str, keep: Sequence[str]) -> DataFrame:
    """The first position where position_id * mask is largest, with the columns to keep."""
    rank = F.struct((F.col("position_id") * F.col(mask)).alias("p"), (-F.col(pos)).alias("first"))
    picked = F.max_by(F.struct(pos, *keep), rank).alias("__row")
    return tokens.groupBy(*seq).agg(picked).select(*seq, "__row.*")


def expand_to_tokens(tokens: DataFrame, per_seq: DataFrame, seq: Sequence[str], pos: str, score: str,
                     response_start: int = 0) -> DataFrame:
    """Place a sequence score on its last valid token, zero elsewhere; keep the response part."""
    placed = per_seq.select(*seq, F.col(pos).alias("__at"), F.col(score).alias("__score"))
    out = attach(tokens.where(F.col(pos) >= response_start), placed, seq)
    return (out.withColumn("token_score", F.when(F.col(pos) == F.col("__at"), F.col("__score")).otherwise(0.0))
            .drop("__at", "__score"))


def place_outcome_reward(tokens: DataFrame, scores: DataFrame, seq: Sequence[str], pos: str, mask: str,
                         score: str) -> DataFrame:
    """Outcome score at the last valid position; no valid token wraps to the last column."""
    ends = tokens.groupBy(*seq).agg(F.sum(mask).alias("__valid"), F.max(pos).alias("__last"))
    spots = attach(ends, scores.select(*seq, F.col(score).alias("__score")), seq).withColumn(
        "__at", F.when(F.col("__valid") == 0, F.col("__last")).otherwise(F.col("__valid") - 1))
    out = attach(tokens, spots.select(*seq, "__at", "__score"), seq)
    return (out.withColumn("reward", F.when(F.col(pos) == F.col("__at"), F.col("__score")).otherwise(0.0))
            .drop("__at", "__score"))
