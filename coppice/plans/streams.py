"""Streaming jobs run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import jobs
from .common import query, table
from .rollouts import STEPS_SQL


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = jobs.stream_table(spark, sf_dir, "events.parquet", schema)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_score", """SELECT p_partkey, CASE WHEN p_size % 4 <> 0 AND p_size = p_size + p_partkey % 2 THEN 1.0::DOUBLE ELSE 0 END AS score FROM part""")
def stream_score(spark, sf_dir):
    parts = jobs.stream_table(spark, sf_dir, "part.parquet", table(spark, sf_dir, "part").schema)
    box = F.concat(F.lit("so \\boxed{"), F.col("p_size").cast("string"), F.lit("}"))
    completion = F.when(F.col("p_size") % 4 != 0, box).otherwise(F.lit("nothing"))
    truth = F.col("p_size") + F.col("p_partkey") % 2
    path = jobs.run_available(jobs.score_stream(parts, completion, truth).select("p_partkey", "score"), "stream-score")
    return spark.read.schema("p_partkey bigint, score double").parquet(path)


@query("stream_step_metrics", """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def stream_step_metrics(spark, sf_dir):
    closed = jobs.step_metrics_stream(event_stream(spark, sf_dir), "ts", "event_type", "value")
    path = jobs.run_available(closed, "stream-metrics")
    back = spark.read.schema("window_start timestamp, metric string, n bigint, mean double").parquet(path)
    return back.select(F.unix_seconds("window_start").alias("window_start"), "metric", "n", F.round("mean", 6).alias("mean"))


@query("stream_group_advantage", """SELECT event_id // 8 AS group_id, event_id AS row_id, count(*) OVER w AS n,
round((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6), 6) + 0.0 AS advantage FROM events WINDOW w AS (PARTITION BY event_id // 8)""")
def stream_group_advantage(spark, sf_dir):
    events = event_stream(spark, sf_dir).withColumn("uid", F.floor(F.col("event_id") / 8))
    out = jobs.group_advantage_stream(events, "uid", "event_id", "value", "ts", group_size=8)
    path = jobs.run_available(out, "stream-advantage")
    back = spark.read.schema("group_id bigint, row_id bigint, advantage double, n bigint").parquet(path)
    return back.withColumn("advantage", F.round("advantage", 6))


@query("stream_kl_controller", "WITH RECURSIVE " + STEPS_SQL + """,
o AS (SELECT *, 1 + greatest(least(kl / 5 - 1, 0.2), -0.2) * n_steps / 1000.0::DOUBLE AS mult, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM steps),
b AS (SELECT run, step, i, 0.2::DOUBLE AS beta, 0.2::DOUBLE * mult AS nxt FROM o WHERE i = 1
  UNION ALL SELECT o.run, o.step, o.i, b.nxt, b.nxt * o.mult FROM b JOIN o ON o.run = b.run AND o.i = b.i + 1)
SELECT run, step, round(beta, 8) AS beta, round(nxt, 8) AS beta_next FROM b""")
def stream_kl_controller(spark, sf_dir):
    steps = (table(spark, sf_dir, "events")
             .groupBy(F.col("event_type").alias("run"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint").alias("step"))
             .agg((F.avg("value") / 10).alias("kl"), F.count(F.lit(1)).alias("n_steps")))
    source = scratch_path(spark, "kl-steps")
    steps.write.parquet(source)
    stream = spark.readStream.schema("run string, step bigint, kl double, n_steps bigint").parquet(source)
    path = jobs.run_available(jobs.kl_controller_stream(stream, 0.2, 5.0, 1000.0), "stream-kl")
    back = spark.read.schema("run string, step bigint, beta double, beta_next double").parquet(path)
    return back.select("run", "step", F.round("beta", 8).alias("beta"), F.round("beta_next", 8).alias("beta_next"))
