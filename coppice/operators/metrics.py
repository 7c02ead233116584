"""Masked aggregates and training / evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import attach, one_row

# Peak dense bf16 FLOP/s by device-name fragment, in match order.
DEVICE_PEAK_FLOPS = [
    ("H100", 989e12), ("H800", 989e12),
    ("A100", 312e12), ("A800", 312e12),
    ("L40", 181.05e12),
    ("L20", 119.5e12),
    ("H20", 148e12),
    ("910B", 354e12),
]
# Sections of one training step whose time is set against prompt + response tokens.
OVERALL_TOKEN_SECTIONS = ["ref", "values", "adv", "update_critic", "update_actor"]
RESPONSE_TOKEN_SECTIONS = ["gen"]


# Masked aggregates: expressions for groupBy().agg() or select(); an empty mask gives null.
def masked_sum(value: Column, mask: Column) -> Column:
    return F.sum(value * mask)


def masked_mean(value: Column, mask: Column) -> Column:
    return F.try_divide(F.sum(value * mask), F.sum(mask))


def masked_var(value: Column, mask: Column, unbiased: bool = True) -> Column:
    """Variance of the positions whose 0/1 mask is set; fewer than two of them is an error."""
    kept = F.when(mask == 1, value)
    spread = F.var_samp(kept) if unbiased else F.var_pop(kept)
    return F.when(F.count(kept) > 1, spread).otherwise(
        F.raise_error(F.lit("masked variance needs at least two masked positions")).cast("double"))


def masked_whiten(df: DataFrame, value: str, mask: str, out: str | None = None, batch: Sequence[str] = (),
                  shift_mean: bool = True) -> DataFrame:
    """Whiten every position with the masked mean and variance of its whole batch."""
    mean = masked_mean(F.col(value), F.col(mask)).alias("__mean")
    var = masked_var(F.col(value), F.col(mask)).alias("__var")
    if batch:
        source = attach(df, df.groupBy(*batch).agg(mean, var), batch)
        m, v = F.col("__mean"), F.col("__var")
    else:
        stats = one_row(df, mean, var)
        source, m, v = df, stats["__mean"], stats["__var"]
    white = (F.col(value) - m) / F.sqrt(v + 1e-8)
    if not shift_mean:
        white = white + m
    return source.withColumn(out or value, white).drop("__mean", "__var")


def explained_variance(returns: Column, values: Column) -> Column:
    return 1.0 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


def to_metric_rows(wide: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per metric: (keys, metric, value)."""
    names = list(metrics or [c for c in wide.columns if c not in keys])
    typed = wide.select(*keys, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return typed.unpivot([F.col(k) for k in keys], [F.col(f"`{n}`") for n in names], "metric", "value")


def _spread(prefix: str, column: str) -> list[Column]:
    c = F.col(column)
    return [F.avg(c).alias(f"{prefix}/mean"), F.max(c).alias(f"{prefix}/max"), F.min(c).alias(f"{prefix}/min")]


def data_metrics(tokens: DataFrame, sequences: DataFrame, seq: Sequence[str], max_response_length: int,
                 max_prompt_length: int, use_critic: bool = True) -> DataFrame:
    """Score, reward, advantage, return, value and length metrics.

    ``tokens``: seq keys, score, reward, advantage, returns, value, mask. ``sequences``: seq keys,
    prompt_length, response_length (one row each).
    """
    per_seq = tokens.groupBy(*seq).agg(F.sum("score").alias("score"), F.sum("reward").alias("reward"))
    totals = per_seq.agg(*_spread("critic/score", "score"), *_spread("critic/rewards", "reward"))
    valid = tokens.where(F.col("mask") == 1)
    token_aggs = [*_spread("critic/advantages", "advantage"), *_spread("critic/returns", "returns")]
    if use_critic:
        token_aggs += [*_spread("critic/values", "value"),
                       explained_variance(F.col("returns"), F.col("value")).alias("critic/vf_explained_var")]
    at_token = valid.agg(*token_aggs)
    lengths = sequences.agg(
        *_spread("response_length", "response_length"), *_spread("prompt_length", "prompt_length"),
        F.avg((F.col("response_length") == max_response_length).cast("double")).alias("response_length/clip_ratio"),
        F.avg((F.col("prompt_length") == max_prompt_length).cast("double")).alias("prompt_length/clip_ratio"))
    return to_metric_rows(totals).unionByName(to_metric_rows(at_token)).unionByName(to_metric_rows(lengths))


def timing_metrics(timings: DataFrame, sequences: DataFrame) -> DataFrame:
    """Seconds per section, and milliseconds per token for sections that process tokens."""
    tokens = one_row(sequences, F.sum("prompt_length").alias("p"), F.sum("response_length").alias("r"))
    per_section = (F.when(F.col("section").isin(RESPONSE_TOKEN_SECTIONS), tokens["r"])
                   .when(F.col("section").isin(OVERALL_TOKEN_SECTIONS), tokens["p"] + tokens["r"]))
    seconds = timings.select(F.concat(F.lit("timing_s/"), "section").alias("metric"),
                             F.col("seconds").alias("value"))
    per_token = (timings.withColumn("__tokens", per_section).where(F.col("__tokens").isNotNull())
                 .select(F.concat(F.lit("timing_per_token_ms/"), "section").alias("metric"),
                         (F.col("seconds") * 1000 / F.col("__tokens")).alias("value")))
    return seconds.unionByName(per_token)


def reduce_metrics(metrics: DataFrame, keys: Sequence[str] = ("run", "step")) -> DataFrame:
    return metrics.groupBy(*keys, "metric").agg(F.avg("value").alias("value"))


def metrics_line(metrics: DataFrame, keys: Sequence[str] = ("run", "step")) -> DataFrame:
    """Console line ``step:N - name:value`` of the numeric metrics of a step, three decimals."""
    items = F.sort_array(F.collect_list(F.struct(
        F.col("metric"), F.format_string("%s:%.3f", F.col("metric"), F.col("value")).alias("text"))))
    return (metrics.where(F.col("value").isNotNull()).groupBy(*keys).agg(items.alias("items"))
            .select(*keys, F.concat_ws(" - ", F.concat(F.lit("step:"), F.col("step").cast("string")),
                                       F.array_join(F.transform("items", lambda x: x["text"]), " - "))
                    .alias("line")))


def group_accuracy(scored: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    """Mean, spread and size per group; a single sample counts as mean 0, spread 1."""
    s = F.col(score)
    n = F.count(s)
    return scored.groupBy(*group).agg(
        n.alias("n"),
        F.when(n > 1, F.avg(s)).otherwise(0.0).alias("mean"),
        F.when(n > 1, F.stddev_samp(s)).otherwise(1.0).alias("std"))


def seqlen_balance_stats(lengths: DataFrame, k: int, pos: str = "pos", length: str = "length",
                         part: str = "part", prefix: str = "global_seqlen") -> DataFrame:
    """Chunk sums in the original order against the sums of the balanced parts."""
    n = one_row(lengths, F.count(F.lit(1)).alias("n"))["n"]
    chunk = F.floor(F.col(pos) / F.floor(n / F.lit(k)))
    before = lengths.groupBy(chunk.alias("__chunk")).agg(F.sum(length).alias("s")).agg(
        F.min("s").alias(f"{prefix}/min"), F.max("s").alias(f"{prefix}/max"),
        (F.max("s") - F.min("s")).alias(f"{prefix}/minmax_diff"),
        (F.sum("s") / F.lit(k)).alias(f"{prefix}/mean"))
    after = lengths.groupBy(part).agg(F.sum(length).alias("s")).agg(
        F.min("s").alias(f"{prefix}/balanced_min"), F.max("s").alias(f"{prefix}/balanced_max"))
    return to_metric_rows(before).unionByName(to_metric_rows(after))


def device_peak(device: Column, unit: float = 1e12) -> Column:
    """Peak FLOP/s of the first device-name fragment found, in ``unit``; unknown devices are infinite."""
    peak = None
    for fragment, flops in DEVICE_PEAK_FLOPS:
        hit = device.contains(fragment)
        peak = F.when(hit, F.lit(flops / unit)) if peak is None else peak.when(hit, F.lit(flops / unit))
    return peak.otherwise(F.lit(float("inf")))


def flops_estimate(config: dict, token_sum: Column, square_sum: Column, seconds: Column) -> Column:
    """Achieved TFLOP/s of a decoder-only transformer: dense part plus attention part; unknown family -> 0."""
    if config.get("model_type") not in ("qwen2", "llama"):
        return F.lit(0.0)
    hidden, layers = config["hidden_size"], config["num_hidden_layers"]
    heads, kv_heads = config["num_attention_heads"], config["num_key_value_heads"]
    head_dim = hidden // heads
    attention_weights = hidden * head_dim * (2 * heads + 2 * kv_heads)
    weights = layers * (3 * hidden * config["intermediate_size"] + attention_weights)
    weights += 2 * config["vocab_size"] * hidden
    dense = F.lit(6.0 * weights) * token_sum
    attention = F.lit(12.0 * head_dim * heads * layers) * square_sum
    return (dense + attention) / seconds / F.lit(1e12)


def model_flops_utilisation(achieved: Column, epochs: Column | int, peak: Column, world_size: int) -> Column:
    times = epochs if isinstance(epochs, Column) else F.lit(epochs)
    return achieved * times / peak / F.lit(world_size)


def sft_token_loss(tokens: DataFrame, micro_batch: Sequence[str], step: Sequence[str],
                   dp_size: int | None = None) -> DataFrame:
    """Masked token loss per micro-batch, then the mean over the micro-batches of a step.

    With ``dp_size`` the valid tokens are counted over all ranks of the step (column ``rank``) and the
    loss is scaled by the number of ranks.
    """
    per = tokens.groupBy(*step, *micro_batch).agg(F.sum(F.col("loss") * F.col("mask")).alias("loss"),
                                                  F.sum("mask").alias("valid"))
    if dp_size:
        across = [c for c in micro_batch if c != "rank"]
        whole = per.groupBy(*step, *across).agg(F.sum("valid").alias("__all"))
        per = attach(per, whole, [*step, *across]).withColumn("valid", F.col("__all"))
    loss = F.col("loss") / F.col("valid") * F.lit(dp_size or 1)
    return per.groupBy(*step).agg(F.avg(loss).alias("loss"))
