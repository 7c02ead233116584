"""Per-token expressions of the policy-gradient objective."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_by_value(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.least(x, _col(high)), _col(low))


def kl_penalty(logprob: Column, ref_logprob: Column, kind: str = "kl") -> Column:
    gap = logprob - ref_logprob
    if kind == "kl":
        return gap
    if kind == "abs":
        return F.abs(gap)
    if kind == "mse":
        return F.lit(0.5) * gap * gap
    if kind == "low_var_kl":
        back = ref_logprob - logprob
        return clip_by_value(F.exp(back) - back - 1.0, -10.0, 10.0)
    raise NotImplementedError(f"unknown kl penalty {kind!r}")


def policy_objective(old_logprob: Column, logprob: Column, advantage: Column, clip: float) -> dict[str, Column]:
    """Clipped surrogate per token: loss, clip flag and the KL estimate."""
    ratio = F.exp(logprob - old_logprob)
    plain = -advantage * ratio
    clipped = -advantage * clip_by_value(ratio, 1.0 - clip, 1.0 + clip)
    return {"loss": F.greatest(plain, clipped),
            "clipped": F.when(clipped > plain, 1.0).otherwise(0.0),
            "kl": old_logprob - logprob}


def value_objective(predicted: Column, returns: Column, old_value: Column, clip: float) -> dict[str, Column]:
    bounded = clip_by_value(predicted, old_value - clip, old_value + clip)
    plain = (predicted - returns) * (predicted - returns)
    clipped = (bounded - returns) * (bounded - returns)
    return {"loss": F.lit(0.5) * F.greatest(plain, clipped),
            "clipped": F.when(clipped > plain, 1.0).otherwise(0.0)}


def log_sum_exp(logits: Column) -> Column:
    """Max-shifted log-sum-exp of an array of doubles."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def entropy_from_logits(logits: Column) -> Column:
    top = F.array_max(logits)
    mass = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    weighted = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top) * x)
    return top + F.log(mass) - weighted / mass


def token_logprob(logits: Column, label: Column, temperature: float = 1.0) -> Column:
    scaled = logits if temperature == 1.0 else F.transform(logits, lambda x: x / F.lit(temperature))
    return F.element_at(scaled, label.cast("int") + 1) - log_sum_exp(scaled)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
