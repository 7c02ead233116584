"""Reward management and evaluation: scores of records, their place in the token row, accuracy tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewards import SCORERS, let, prefer_model_score
from ..functions.tokens import mask_total
from .batch import fanout_rollouts, sample_per_source


def score_records(rows: DataFrame, source: str, text: str, truth: str, model_score: str | None = None, extra: str | None = None,
                  scorers: dict[str, Callable[..., Column]] | None = None, out: str = "score") -> DataFrame:
    """``out``: the model's score where there is one, else the score of the row's source.

    A scorer takes (text, truth), and the ``extra`` column too when one is named. An unknown source is an error unless
    the row has a model score.
    """
    args = [F.col(c) for c in (text, truth, *([extra] if extra else []))]
    name, rule = F.col(source), None
    for key, scorer in (scorers or SCORERS).items():
        value = scorer(*args).cast("double")
        rule = F.when(name == key, value) if rule is None else rule.when(name == key, value)
    rule = rule.otherwise(F.raise_error(F.concat(F.lit("no scorer for data source "), F.coalesce(name, F.lit("null")))).cast("double"))
    return rows.withColumn(out, prefer_model_score(F.col(model_score).cast("double"), rule) if model_score else rule)


def reward_position(mask: Column) -> Column:
    """Index of the last valid token; a row without one takes its last column, an empty row has none."""
    valid = mask_total(mask)
    return F.when(F.size(mask) > 0, F.when(valid > 0, valid - 1).otherwise(F.size(mask) - 1).cast("int"))


def placed_reward(mask: Column, score: Column) -> Column:
    """The score on the last valid token of the row, zero elsewhere. The position is bound once, not found again per token."""
    return let(reward_position(mask), lambda at: F.transform(mask, lambda _, i: F.when(i == at, score).otherwise(F.lit(0.0))))


def manage_rewards(rows: DataFrame, source: str, text: str, truth: str, mask: str, show: int = 0, order: str | None = None,
                   **scoring) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``score`` and ``token_rewards``, and the first ``show`` rows of every source for the log."""
    scored = score_records(rows, source, text, truth, **scoring)
    scored = scored.withColumn("token_rewards", placed_reward(F.col(mask), F.col("score")))
    return scored, sample_per_source(scored, source, order or text, show) if show else None


def accuracy_by(rows: DataFrame, keys: Sequence[str], reward: str = "reward", length: str | None = None) -> DataFrame:
    """correct, total and accuracy per key, and the mean length when a length column is named."""
    more = [F.avg(length).alias("mean_length")] if length else []
    return rows.groupBy(*keys).agg(F.sum(reward).alias("correct"), F.count(F.lit(1)).alias("total"), F.avg(reward).alias("accuracy"), *more)


def sequence_scores(tokens: DataFrame, seq: Sequence[str], score: str = "score") -> DataFrame:
    return tokens.groupBy(*seq).agg(F.sum(score).alias("s"))


def mean_score(per_seq: DataFrame, by: str | None = None) -> DataFrame:
    """``val_score`` over all sequences; with ``by`` also per category, the whole as ``all``."""
    if by is None:
        return per_seq.agg(F.avg("s").alias("val_score"))
    return per_seq.rollup(by).agg(F.avg("s").alias("val_score")).select(F.coalesce(by, F.lit("all")).alias("data_source"), "val_score")


def evaluate_sets(prompts: DataFrame, responses: DataFrame, uid: str, n: int, scorer: Callable[[Column, Column], Column],
                  template: Callable[[Column], Column] | None = None, set_name: str = "set_name", query: str = "query",
                  truth: str = "ground_truth", completion: str = "completion") -> DataFrame:
    """Every prompt of every named set ``n`` times with its responses (uid, sample, completion), scored as ``reward``."""
    shaped = prompts.withColumn(query, template(F.col(query))) if template else prompts
    joined = fanout_rollouts(shaped, responses, uid, n)
    return joined.select(set_name, uid, "sample", query, truth, completion, scorer(F.col(completion), F.col(truth)).cast("double").alias("reward"),
                         F.length(completion).cast("bigint").alias("response_length"))
