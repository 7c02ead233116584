"""Masked aggregates, evaluation and training metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import word_tokens
from ..operators import balance, batch
from ..operators import scoring
from ..operators import metrics as M
from ..operators.records import zero_answer_ratio as zero_ratio
from .bindings import EXCHANGES_SQL, LENGTHS_SQL, TOKENS_SQL, WORDS, document_lengths, mask_rows, rollout_tokens
from .common import bound, plain, query, table

TOK = f"WITH tok AS ({TOKENS_SQL})"


def r6(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


@query("masked_sum", TOK + " SELECT uid, round(sum(score * mask), 6) + 0.0 AS masked_sum FROM tok GROUP BY uid")
def masked_sum(spark, sf_dir):
    t = rollout_tokens(spark, sf_dir)
    return t.groupBy("uid").agg(r6(M.masked_sum(F.col("score"), F.col("mask")), "masked_sum"))


@query("masked_mean", TOK + """ SELECT uid, sample, coalesce(round(sum(score * mask) / nullif(sum(mask), 0), 6), -1)
AS masked_mean FROM tok GROUP BY uid, sample""")
def masked_mean(spark, sf_dir):
    t = rollout_tokens(spark, sf_dir)
    value = F.round(M.masked_mean(F.col("score"), F.col("mask")), 6)
    return t.groupBy("uid", "sample").agg(F.coalesce(value, F.lit(-1.0)).alias("masked_mean"))


@query("masked_var", TOK + """ SELECT uid, round(var_samp(score) FILTER (mask = 1), 5) AS masked_var,
round(var_pop(score) FILTER (mask = 1), 5) AS masked_var_biased FROM tok GROUP BY uid""")
def masked_var(spark, sf_dir):
    v, m = F.col("score"), F.col("mask")
    return rollout_tokens(spark, sf_dir).groupBy("uid").agg(
        F.round(M.masked_var(v, m), 5).alias("masked_var"),
        F.round(M.masked_var(v, m, unbiased=False), 5).alias("masked_var_biased"))


@query("masked_whiten", TOK + """, g AS (SELECT avg(score) AS m, var_samp(score) AS v FROM tok WHERE mask = 1),
b AS (SELECT uid, avg(score) AS m, var_samp(score) AS v FROM tok WHERE mask = 1 GROUP BY uid)
SELECT event_id, round((score - g.m) / sqrt(g.v + 1e-8), 6) + 0.0 AS whitened,
round((score - b.m) / sqrt(b.v + 1e-8) + b.m, 6) + 0.0 AS per_batch FROM tok JOIN b USING (uid), g""")
def masked_whiten(spark, sf_dir):
    t = M.masked_whiten(rollout_tokens(spark, sf_dir), "score", "mask", out="whitened")
    t = M.masked_whiten(t, "score", "mask", out="per_batch", batch=["uid"], shift_mean=False)
    return t.select("event_id", r6("whitened", "whitened"), r6("per_batch", "per_batch"))


EVAL = "SELECT p_brand AS name, CASE WHEN p_size % 3 = 0 THEN 1.0E0 ELSE 0.0E0 END AS reward, length(p_name) AS n FROM {part}"


@query("accuracy_eval", f"""SELECT name, round(sum(reward), 6) AS correct, count(*) AS total, round(avg(reward), 6) AS accuracy,
round(avg(n), 6) AS mean_length FROM ({plain(EVAL)}) GROUP BY name""")
def accuracy_eval(spark, sf_dir):
    table = scoring.accuracy_by(bound(spark, sf_dir, EVAL), ["name"], "reward", "n")
    return table.select("name", r6("correct", "correct"), "total", r6("accuracy", "accuracy"), r6("mean_length", "mean_length"))


@query("val_score", TOK + ", s AS (SELECT sum(score) AS s FROM tok GROUP BY uid, sample) SELECT round(avg(s), 6) AS val_score FROM s")
def val_score(spark, sf_dir):
    per = scoring.sequence_scores(rollout_tokens(spark, sf_dir), ["uid", "sample"])
    return scoring.mean_score(per).select(r6("val_score", "val_score"))


@query("val_score_by_source", TOK + """, s AS (SELECT uid % 5 AS src, sum(score) AS s FROM tok GROUP BY uid, sample)
SELECT CASE WHEN src IS NULL THEN 'all' ELSE CAST(src AS VARCHAR) END AS data_source, round(avg(s), 6) AS val_score
FROM s GROUP BY ROLLUP (src)""")
def val_score_by_source(spark, sf_dir):
    per = scoring.sequence_scores(rollout_tokens(spark, sf_dir), ["uid", "sample"]).withColumn("src", (F.col("uid") % 5).cast("string"))
    return scoring.mean_score(per, "src").select("data_source", r6("val_score", "val_score"))


@query("response_info", f"WITH {EXCHANGES_SQL} SELECT row_id, np AS prompt_length, nr AS response_length FROM e")
def response_info(spark, sf_dir):
    from ..functions.tokens import mask_lengths
    prompt, response = mask_lengths(F.col("attention_mask"), F.col("top_r"))
    return mask_rows(spark, sf_dir).select("row_id", prompt.alias("prompt_length"), response.alias("response_length"))


@query("token_counts", f"WITH {EXCHANGES_SQL} SELECT row_id, np + nr AS n_tokens FROM e")
def token_counts(spark, sf_dir):
    from ..functions.tokens import mask_total
    return mask_rows(spark, sf_dir).select("row_id", mask_total(F.col("attention_mask")).alias("n_tokens"))


DATA_TOK = TOK + """, k AS (SELECT *, score - 0.1::DOUBLE * (old_lp - ref_lp) * mask AS reward, score - 20 AS adv, score / 10 AS ret FROM tok),
s AS (SELECT uid, sample, sum(score) AS score, sum(reward) AS reward, CAST(sum(mask) AS BIGINT) AS r, sample % 13 AS p FROM k GROUP BY uid, sample),
v AS (SELECT * FROM k WHERE mask = 1)
"""


def _spread_sql(prefix, column, source):
    return " UNION ALL ".join(
        f"SELECT '{prefix}/{name}' AS metric, CAST({fn}({column}) AS DOUBLE) AS value FROM {source}"
        for name, fn in (("mean", "avg"), ("max", "max"), ("min", "min")))


DATA_SQL = DATA_TOK + "SELECT metric, round(value, 5) + 0.0 AS value FROM (" + " UNION ALL ".join([
    _spread_sql("critic/score", "score", "s"), _spread_sql("critic/rewards", "reward", "s"),
    _spread_sql("critic/advantages", "adv", "v"), _spread_sql("critic/returns", "ret", "v"),
    _spread_sql("critic/values", "val", "v"), _spread_sql("response_length", "r", "s"),
    _spread_sql("prompt_length", "p", "s"),
    "SELECT 'critic/vf_explained_var', 1 - var_samp(ret - val) / (var_samp(ret) + 1e-5) FROM v",
    "SELECT 'response_length/clip_ratio', avg(CASE WHEN r = 4 THEN 1.0::DOUBLE ELSE 0 END) FROM s",
    "SELECT 'prompt_length/clip_ratio', avg(CASE WHEN p = 12 THEN 1.0::DOUBLE ELSE 0 END) FROM s"]) + ")"


@query("data_metrics", DATA_SQL)
def data_metrics(spark, sf_dir):
    from ..operators.advantage import token_rewards
    tokens = token_rewards(rollout_tokens(spark, sf_dir), 0.1).select(
        "uid", "sample", "score", "reward", (F.col("score") - 20).alias("advantage"),
        (F.col("score") / 10).alias("returns"), F.col("val").alias("value"), "mask")
    sequences = tokens.groupBy("uid", "sample").agg(F.sum("mask").alias("response_length")).withColumn(
        "prompt_length", F.col("sample") % 13)
    out = M.data_metrics(tokens, sequences, ["uid", "sample"], max_response_length=4, max_prompt_length=12)
    return out.select("metric", F.round("value", 5).alias("value"))


@query("explained_variance", TOK + """ SELECT round(1 - var_samp(score / 10 - val) / (var_samp(score / 10) + 1e-5), 6) AS explained_var
FROM tok WHERE mask = 1""")
def explained_variance(spark, sf_dir):
    valid = rollout_tokens(spark, sf_dir).where(F.col("mask") == 1)
    return valid.agg(r6(M.explained_variance(F.col("score") / 10, F.col("val")), "explained_var"))


TIMINGS = """SELECT CASE event_type WHEN 'click' THEN 'gen' WHEN 'view' THEN 'ref' WHEN 'purchase' THEN 'adv'
  WHEN 'signup' THEN 'update_actor' ELSE 'load' END AS section, value AS seconds FROM {events}"""


@query("timing_metrics", f"""WITH t AS (SELECT section, sum(seconds) AS s FROM ({plain(TIMINGS)}) GROUP BY section),
n AS (SELECT sum(p) AS p, sum(r) AS r FROM ({LENGTHS_SQL}))
SELECT 'timing_s/' || section AS metric, round(s, 4) AS value FROM t UNION ALL
SELECT 'timing_per_token_ms/' || section, round(s * 1000 / CASE WHEN section = 'gen' THEN r ELSE p + r END, 4)
FROM t, n WHERE section <> 'load'""")
def timing_metrics(spark, sf_dir):
    timings = bound(spark, sf_dir, TIMINGS).groupBy("section").agg(F.sum("seconds").alias("seconds"))
    sequences = document_lengths(spark, sf_dir).select(F.col("p").alias("prompt_length"), F.col("r").alias("response_length"))
    return M.timing_metrics(timings, sequences).select("metric", F.round("value", 4).alias("value"))


METRIC_ROWS = """SELECT 'run' || (event_id % 3) AS run, event_id % 20 AS step, event_type AS metric, value FROM {events}"""


@query("reduce_metrics", f"SELECT run, step, metric, round(avg(value), 6) AS value FROM ({plain(METRIC_ROWS)}) GROUP BY ALL")
def reduce_metrics(spark, sf_dir):
    return M.reduce_metrics(bound(spark, sf_dir, METRIC_ROWS)).select("run", "step", "metric", r6("value", "value"))


@query("metrics_line", f"""SELECT run, step, 'step:' || step || ' - ' || string_agg(printf('%s:%.3f', metric, v), ' - ' ORDER BY metric) AS line
FROM (SELECT run, step, metric, max(value) AS v FROM ({plain(METRIC_ROWS)}) GROUP BY ALL) GROUP BY run, step""")
def metrics_line(spark, sf_dir):
    rows = bound(spark, sf_dir, METRIC_ROWS).groupBy("run", "step", "metric").agg(F.max("value").alias("value"))
    return M.metrics_line(rows)


@query("group_accuracy", TOK + """, s AS (SELECT uid, sample, sum(score) AS s FROM tok GROUP BY uid, sample)
SELECT uid, count(*) AS n, round(CASE WHEN count(*) > 1 THEN avg(s) ELSE 0 END, 6) AS mean,
round(CASE WHEN count(*) > 1 THEN stddev_samp(s) ELSE 1 END, 6) AS std FROM s GROUP BY uid""")
def group_accuracy(spark, sf_dir):
    scored = rollout_tokens(spark, sf_dir).groupBy("uid", "sample").agg(F.sum("score").alias("score"))
    return M.group_accuracy(scored, ["uid"]).select("uid", "n", r6("mean", "mean"), r6("std", "std"))


BAL = f"WITH d AS (SELECT doc_id AS pos, len({WORDS.format('text')}) AS length FROM documents), n AS (SELECT count(*) AS n FROM d)"
SNAKE = BAL + """, o AS (SELECT *, row_number() OVER (ORDER BY length DESC, pos) - 1 AS rk FROM d),
a AS (SELECT pos, length, CASE WHEN (rk // 8) % 2 = 0 THEN rk % 8 ELSE 7 - rk % 8 END AS part FROM o)"""


@query("seqlen_balance_stats", SNAKE + """, c AS (SELECT pos // (n // 8) AS c, sum(length) AS s FROM d, n GROUP BY 1),
b AS (SELECT part, sum(length) AS s FROM a GROUP BY part)
SELECT 'global_seqlen/min' AS metric, min(s)::DOUBLE AS value FROM c UNION ALL SELECT 'global_seqlen/max', max(s) FROM c
UNION ALL SELECT 'global_seqlen/minmax_diff', max(s) - min(s) FROM c UNION ALL SELECT 'global_seqlen/mean', sum(s) / 8 FROM c
UNION ALL SELECT 'global_seqlen/balanced_min', min(s) FROM b UNION ALL SELECT 'global_seqlen/balanced_max', max(s) FROM b""")
def seqlen_balance_stats(spark, sf_dir):
    return M.seqlen_balance_stats(snake(spark, sf_dir), 8)


def snake(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.size(word_tokens(F.col("text"))).cast("bigint").alias("length"))
    return balance.balance_snake(docs, "pos", F.col("length"), 8)


@query("balance_snake", SNAKE + " SELECT pos, part FROM a")
def balance_snake(spark, sf_dir):
    return snake(spark, sf_dir).select("pos", "part")


CONFIG = {"model_type": "qwen2", "hidden_size": 1536, "num_hidden_layers": 28, "num_attention_heads": 12,
          "num_key_value_heads": 2, "intermediate_size": 8960, "vocab_size": 151936}
FLOPS_SQL = f"""SELECT source, (6.0::DOUBLE * ((1536 * 8960 * 3 + 1536 * (12 * 128 + 2 * 128 + 2 * 128 + 12 * 128)) * 28
  + 151936 * 1536 * 2) * sum(p + r) + 12.0::DOUBLE * sum((p + r) * (p + r)) * 128 * 12 * 28) / 0.5 / 1e12 AS f
  FROM ({LENGTHS_SQL}) GROUP BY source"""


def _flops(spark, sf_dir):
    n = (F.col("p") + F.col("r")).cast("double")
    return document_lengths(spark, sf_dir).groupBy("source").agg(
        M.flops_estimate(CONFIG, F.sum(n), F.sum(n * n), F.lit(0.5)).alias("f"))


@query("flops_estimate", f"SELECT source, round(f, 6) AS tflops, 0.0::DOUBLE AS unknown_model FROM ({FLOPS_SQL})")
def flops_estimate(spark, sf_dir):
    unknown = M.flops_estimate({"model_type": "other"}, F.col("f"), F.col("f"), F.lit(1.0))
    return _flops(spark, sf_dir).select("source", r6("f", "tflops"), unknown.alias("unknown_model"))


DEVICES = """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'NVIDIA H100 80GB' WHEN 1 THEN 'A800-SXM' WHEN 2 THEN 'L40S'
  WHEN 3 THEN 'L20' WHEN 4 THEN 'H20' WHEN 5 THEN 'Ascend910B' ELSE p_name END AS device FROM {part}"""


@query("device_peak_lookup", f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 989.0::DOUBLE WHEN 1 THEN 312 WHEN 2 THEN 181.05
WHEN 3 THEN 119.5 WHEN 4 THEN 148 WHEN 5 THEN 354 ELSE 'inf'::DOUBLE END AS peak FROM ({plain(DEVICES)})""")
def device_peak_lookup(spark, sf_dir):
    return bound(spark, sf_dir, DEVICES).select("p_partkey", M.device_peak(F.col("device")).alias("peak"))


@query("mfu", f"SELECT source, round(f * 2 / 312 / 8, 8) AS mfu FROM ({FLOPS_SQL})")
def mfu(spark, sf_dir):
    value = M.model_flops_utilisation(F.col("f"), 2, M.device_peak(F.lit("A100")), 8)
    return _flops(spark, sf_dir).select("source", F.round(value, 8).alias("mfu"))


@query("sft_token_loss", TOK + """, m AS (SELECT sample % 5 AS step, uid % 4 AS mb, event_id % 2 AS rank, sum(score * mask) AS l, sum(mask) AS n
  FROM tok GROUP BY ALL),
w AS (SELECT step, mb, rank, l / sum(n) OVER (PARTITION BY step, mb) * 2 AS scaled, l / n AS plain FROM m)
SELECT step, round(avg(plain), 6) AS loss, round(avg(scaled), 6) AS balanced_loss FROM w GROUP BY step""")
def sft_token_loss(spark, sf_dir):
    t = rollout_tokens(spark, sf_dir).select((F.col("sample") % 5).alias("step"), (F.col("uid") % 4).alias("mb"),
                                             (F.col("event_id") % 2).alias("rank"), F.col("score").alias("loss"), "mask")
    plain_loss = M.sft_token_loss(t, ["mb", "rank"], ["step"])
    balanced = M.sft_token_loss(t, ["mb", "rank"], ["step"], dp_size=2).withColumnRenamed("loss", "balanced_loss")
    return plain_loss.join(balanced, "step").select("step", r6("loss", "loss"), r6("balanced_loss", "balanced_loss"))


@query("zero_answer_ratio", "SELECT round(avg(CASE WHEN p_size % 7 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_ratio, count(*) AS n FROM part")
def zero_answer_ratio(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("final_answer"))
    return zero_ratio(raw).select(r6("zero_ratio", "zero_ratio"), "n")
