"""Streaming forms of scoring, step metrics, group advantages and the KL controller.

State is keyed and bounded: a window aggregate, at most one group of responses, or one coefficient per run.
Every job runs from a checkpoint, so a restart continues exactly where it stopped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rewards import score_boxed
from ..session import scratch_path

# The state functions travel with the task, so Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_table(spark, folder: str, name: str, schema) -> DataFrame:
    """A parquet folder (or one file name in it) as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> str:
    """Process all available input into a fresh parquet table and return its path."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    started = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
               .trigger(availableNow=True).start(f"{base}/table"))
    started.awaitTermination()
    return f"{base}/table"


def score_stream(stream: DataFrame, completion: Column, truth: Column, format_scale: float = 0.0) -> DataFrame:
    """The batch scorer on a stream: a stateless projection."""
    return stream.withColumn("score", score_boxed(completion, truth, format_scale))


def step_metrics_stream(stream: DataFrame, ts: str, metric: str, value: str, width: str = "1 day",
                        delay: str = "1 hour") -> DataFrame:
    """Count and mean per window and metric, emitted once the watermark has closed the window."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), F.col(metric).alias("metric"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
            .select(F.col("w.start").alias("window_start"), "metric", "n", "mean"))


def _group_normalised(scores: np.ndarray, eps: float) -> np.ndarray:
    if len(scores) == 1:
        return scores / (1.0 + eps)
    return (scores - scores.mean()) / (scores.std(ddof=1) + eps)


def group_advantage_stream(stream: DataFrame, group: str, row_id: str, score: str, ts: str, group_size: int,
                           delay: str = "1 hour", timeout_ms: int = 3_600_000, eps: float = 1e-6, buckets: int = 4096) -> DataFrame:
    """Group-normalised advantages, emitted when a group has all its responses or its time is up.

    A group is normalised as a whole, so a response beyond ``group_size``, or one that comes after its complete group
    was emitted, is an error. That a group is done is remembered until its time is up, which bounds the state. State is
    kept per hash bucket of groups, each group with its own deadline: one call into Python a bucket, not one a group.
    """
    def unpacked(stored):
        held, start = {}, 0
        groups, deadlines, done, sizes, ids, scores = stored
        for name, deadline, finished, size in zip(groups, deadlines, done, sizes, strict=True):
            held[name] = (deadline, finished, list(ids[start:start + size]), list(scores[start:start + size]))
            start += size
        return held

    def packed(held):
        rows = list(held.values())
        return (list(held), [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows],
                [i for r in rows for i in r[2]], [s for r in rows for s in r[3]])

    def finished(groups):
        sizes = [len(ids) for _, ids, _ in groups]
        names = pd.array([name for name, _, _ in groups], dtype="Int64")
        return pd.DataFrame({"group_id": names.repeat(sizes), "row_id": pd.array([i for _, ids, _ in groups for i in ids], dtype="Int64"),
                             "advantage": np.concatenate([_group_normalised(np.asarray(s, dtype="float64"), eps) for _, _, s in groups]),
                             "n": np.repeat(sizes, sizes)})

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ready, now = unpacked(state.get) if state.exists else {}, [], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            ids, absent = rows["row_id"].to_numpy(), rows["no_row"].to_numpy()
            scores, times = rows["score"].to_numpy(dtype="float64"), rows["ts_ms"].to_numpy()
            for (no_group, group_id), at in rows.groupby(["no_group", "group_id"], sort=False).indices.items():
                name = None if no_group else int(group_id)
                _, done, old_ids, old_scores = held.get(name, (0, False, [], []))
                all_ids = old_ids + [None if absent[i] else int(ids[i]) for i in at]
                all_scores = old_scores + scores[at].tolist()
                if len(all_ids) > (0 if done else group_size):
                    raise ValueError(f"group {name} has more than {group_size} responses")
                if len(all_ids) == group_size:
                    ready.append((name, all_ids, all_scores))
                    all_ids, all_scores, done = [], [], True
                held[name] = (max(int(times[at].max()), now) + timeout_ms, done, all_ids, all_scores)
        for name in [n for n, group in held.items() if group[0] < now]:
            _, _, late_ids, late_scores = held.pop(name)
            if late_ids:
                ready.append((name, late_ids, late_scores))
        if held:
            state.update(packed(held))
            state.setTimeoutTimestamp(min(group[0] for group in held.values()))
        elif state.exists:
            state.remove()
        if ready:
            yield finished(ready)

    name, row = F.col(group).cast("bigint"), F.col(row_id).cast("bigint")
    none = F.lit(0).cast("bigint")
    slim = stream.withWatermark(ts, delay).select(
        F.pmod(F.xxhash64(name), F.lit(buckets)).alias("bucket"), F.coalesce(name, none).alias("group_id"), name.isNull().alias("no_group"),
        F.coalesce(row, none).alias("row_id"), row.isNull().alias("no_row"), F.col(score).cast("double").alias("score"), F.col(ts),
        F.coalesce(F.unix_millis(ts), none).alias("ts_ms"))
    return slim.groupBy("bucket").applyInPandasWithState(
        update, "group_id bigint, row_id bigint, advantage double, n bigint",
        "groups array<bigint>, deadlines array<bigint>, done array<boolean>, sizes array<int>, ids array<bigint>, scores array<double>",
        "append", GroupStateTimeout.EventTimeTimeout)


def kl_controller_stream(steps: DataFrame, init: float, target: float, horizon: float) -> DataFrame:
    """Adaptive KL coefficient per run, carried from step to step in keyed state.

    Steps of one trigger are taken in order; a step that comes after a later one was applied is an error. ``steps`` has
    run, step, kl, n_steps.
    """
    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beta, last = state.get if state.exists else (init, None)
        rows = pd.concat(list(frames)).sort_values("step")
        if last is not None and int(rows["step"].iloc[0]) <= last:
            raise ValueError(f"step {rows['step'].iloc[0]} of run {key[0]} came after step {last}")
        error = np.clip(rows["kl"].to_numpy() / target - 1, -0.2, 0.2)
        after = beta * np.cumprod(1 + error * rows["n_steps"].to_numpy() / horizon)
        state.update((float(after[-1]), int(rows["step"].iloc[-1])))
        yield pd.DataFrame({"run": key[0], "step": rows["step"].to_numpy(), "beta": np.concatenate([[beta], after[:-1]]), "beta_next": after})

    slim = steps.select("run", F.col("step").cast("bigint").alias("step"), F.col("kl").cast("double").alias("kl"),
                        F.col("n_steps").cast("bigint").alias("n_steps"))
    return slim.groupBy("run").applyInPandasWithState(
        update, "run string, step bigint, beta double, beta_next double", "beta double, last bigint", "append", GroupStateTimeout.NoTimeout)
