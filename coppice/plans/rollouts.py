"""Advantages, returns, KL control and losses over rollout tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import losses as L
from ..operators import advantage as A
from ..operators import metrics as M
from ..operators import tokenrows as T
from ..operators.joins import attach
from .bindings import TOKENS_SQL, longest_sequence, rollout_tokens
from .common import query, table

SEQ = ["uid", "sample"]
TOK = f"WITH tok AS ({TOKENS_SQL})"


def r6(column, name=None):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


# ---------------------------------------------------------------- group advantages
GRPO_SQL = TOK + """, s AS (SELECT uid, sample, sum(score) AS s FROM tok GROUP BY uid, sample),
g AS (SELECT uid, count(*) AS n, avg(s) AS m, stddev_samp(s) AS sd FROM s GROUP BY uid),
a AS (SELECT s.uid, s.sample, (s - CASE WHEN n > 1 THEN m ELSE 0 END) / (CASE WHEN n > 1 THEN sd ELSE 1 END + 1e-6) AS a
      FROM s JOIN g USING (uid))
SELECT event_id, round(a.a * mask, 6) + 0.0 AS advantage, round(a.a * mask, 6) + 0.0 AS returns
FROM tok JOIN a USING (uid, sample)"""


@query("adv_grpo", GRPO_SQL)
def adv_grpo(spark, sf_dir):
    out = A.grpo(rollout_tokens(spark, sf_dir), ["uid"], SEQ, reward="score")
    return out.select("event_id", r6("advantage"), r6("returns"))


RLOO_SQL = TOK + """, s AS (SELECT uid, sample, sum(score) AS s FROM tok GROUP BY uid, sample),
a AS (SELECT uid, sample, CASE WHEN count(*) OVER w > 1
   THEN (s - avg(s) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE s END AS a
   FROM s WINDOW w AS (PARTITION BY uid))
SELECT event_id, round(a.a * mask, 6) + 0.0 AS advantage FROM tok JOIN a USING (uid, sample)"""


@query("adv_rloo", RLOO_SQL)
def adv_rloo(spark, sf_dir):
    out = A.rloo(rollout_tokens(spark, sf_dir), ["uid"], SEQ, reward="score")
    return out.select("event_id", r6("advantage"))


@query("group_stat_join", TOK + """, s AS (SELECT uid, sample, sum(score) AS s FROM tok GROUP BY uid, sample)
SELECT uid, sample, round(s, 6) AS score, count(*) OVER w AS n,
  round(CASE WHEN count(*) OVER w > 1 THEN avg(s) OVER w ELSE 0 END, 6) AS mean,
  round(CASE WHEN count(*) OVER w > 1 THEN stddev_samp(s) OVER w ELSE 1 END, 6) AS std
FROM s WINDOW w AS (PARTITION BY uid)""")
def group_stat_join(spark, sf_dir):
    scored = rollout_tokens(spark, sf_dir).groupBy(*SEQ).agg(F.sum("score").alias("score"))
    return A.group_stat_join(scored, ["uid"]).select(*SEQ, r6("score"), "n", r6("mean"), r6("std"))


# ---------------------------------------------------------------- token recurrences
GAE_SQL = TOK + """, d AS (SELECT *, score + 0.9 * coalesce(lead(val) OVER (PARTITION BY uid ORDER BY t), 0) - val
   AS delta FROM tok),
raw AS (SELECT a.event_id, a.mask, a.val, sum(b.delta * power(0.9::DOUBLE * 0.8::DOUBLE, b.t - a.t)) AS adv
   FROM d a JOIN d b ON a.uid = b.uid AND b.t >= a.t GROUP BY ALL),
st AS (SELECT avg(adv) AS m, var_samp(adv) AS v FROM raw WHERE mask = 1)
SELECT event_id, round(adv + val, 6) AS returns, round((adv - m) / sqrt(v + 1e-8), 6) + 0.0 AS advantage FROM raw, st"""


@query("adv_gae", GAE_SQL)
def adv_gae(spark, sf_dir):
    out = A.gae(rollout_tokens(spark, sf_dir, positions=True), ["uid"], reward="score", value="val",
                gamma=0.9, lam=0.8, max_len=longest_sequence(spark, sf_dir))
    return out.select("event_id", r6("returns"), r6("advantage"))


REINFORCE_SQL = TOK.replace("WITH", "WITH RECURSIVE") + """,
r AS (SELECT uid, t, event_id, mask, score AS ret FROM tok
      WHERE t = (SELECT max(t) FROM tok x WHERE x.uid = tok.uid)
  UNION ALL SELECT k.uid, k.t, k.event_id, k.mask, k.score + 0.91372193847 * r.ret * r.mask
      FROM r JOIN tok k ON k.uid = r.uid AND k.t = r.t - 1),
st AS (SELECT avg(ret) AS m, var_samp(ret) AS v FROM r WHERE mask = 1)
SELECT event_id, round(ret, 6) AS returns, round((ret - m) / sqrt(v + 1e-8) * mask, 6) + 0.0 AS advantage FROM r, st"""


@query("adv_reinforce_pp", REINFORCE_SQL)
def adv_reinforce_pp(spark, sf_dir):
    out = A.reinforce_pp(rollout_tokens(spark, sf_dir, positions=True), ["uid"], reward="score", gamma=0.91372193847,
                         max_len=longest_sequence(spark, sf_dir))
    return out.select("event_id", r6("returns"), r6("advantage"))


BASE_SQL = ", b AS (SELECT uid, min(score) AS baseline FROM tok GROUP BY uid)"


REMAX_SQL = TOK + BASE_SQL + """
SELECT event_id, round(ret, 6) + 0.0 AS returns, round(ret - baseline * mask, 6) + 0.0 AS advantage FROM (
  SELECT *, sum(score * mask) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret
  FROM tok JOIN b USING (uid))"""


@query("adv_remax", REMAX_SQL)
def adv_remax(spark, sf_dir):
    tokens = rollout_tokens(spark, sf_dir, positions=True)
    greedy = rollout_tokens(spark, sf_dir).groupBy("uid").agg(F.min("score").alias("baseline"))
    out = A.remax(attach(tokens, greedy, ["uid"]), ["uid"], reward="score")
    return out.select("event_id", r6("returns"), r6("advantage"))


@query("baseline_join", TOK + BASE_SQL + " SELECT event_id, baseline FROM tok JOIN b USING (uid)")
def baseline_join(spark, sf_dir):
    tokens = rollout_tokens(spark, sf_dir)
    greedy = tokens.groupBy("uid").agg(F.min("score").alias("baseline"))
    return attach(tokens, greedy, ["uid"]).select("event_id", "baseline")


@query("advantage", " UNION ALL ".join(f"SELECT '{name}' AS estimator, event_id, advantage FROM ({sql})" for name, sql in (
    ("grpo", GRPO_SQL), ("rloo", RLOO_SQL), ("gae", GAE_SQL), ("reinforce_plus_plus", REINFORCE_SQL), ("remax", REMAX_SQL))))
def advantage(spark, sf_dir):
    """All five estimators by their names."""
    tokens, placed = rollout_tokens(spark, sf_dir), rollout_tokens(spark, sf_dir, positions=True)
    greedy = tokens.groupBy("uid").agg(F.min("score").alias("baseline"))
    longest = longest_sequence(spark, sf_dir)
    parts = [A.advantage(tokens, name, SEQ, ["uid"], reward="score") for name in ("grpo", "rloo")]
    parts += [A.advantage(placed, "gae", ["uid"], gamma=0.9, lam=0.8, reward="score", value="val", max_len=longest),
              A.advantage(placed, "reinforce_plus_plus", ["uid"], gamma=0.91372193847, reward="score", max_len=longest),
              A.advantage(attach(placed, greedy, ["uid"]), "remax", ["uid"], reward="score")]
    named = zip(("grpo", "rloo", "gae", "reinforce_plus_plus", "remax"), parts, strict=True)
    return reduce(DataFrame.unionByName, [part.select(F.lit(name).alias("estimator"), "event_id", r6("advantage")) for name, part in named])


# ---------------------------------------------------------------- KL
@query("kl_penalty", TOK + """ SELECT event_id, round(lp - ref_lp, 6) + 0.0 AS kl, round(abs(lp - ref_lp), 6) AS abs,
round(0.5::DOUBLE * (lp - ref_lp) * (lp - ref_lp), 6) AS mse,
round(greatest(least(exp(ref_lp - lp) - (ref_lp - lp) - 1, 10), -10), 6) + 0.0 AS low_var_kl FROM tok""")
def kl_penalty(spark, sf_dir):
    tokens = rollout_tokens(spark, sf_dir)
    kinds = [r6(L.kl_penalty(F.col("lp"), F.col("ref_lp"), k), k) for k in ("kl", "abs", "mse", "low_var_kl")]
    return tokens.select("event_id", *kinds)


@query("apply_kl_penalty", TOK + """ SELECT event_id, round((old_lp - ref_lp) * mask, 6) + 0.0 AS kld,
round(score - 0.1::DOUBLE * (old_lp - ref_lp) * mask, 6) + 0.0 AS reward FROM tok""")
def apply_kl_penalty(spark, sf_dir):
    return A.token_rewards(rollout_tokens(spark, sf_dir), 0.1).select("event_id", r6("kld"), r6("reward"))


@query("apply_kl_penalty_batch_kl", TOK + """, s AS (SELECT sum((old_lp - ref_lp) * mask) / nullif(sum(mask), 0) AS kl
FROM tok GROUP BY uid, sample) SELECT round(avg(kl), 6) + 0.0 AS current_kl, count(*) AS batch_size FROM s""")
def apply_kl_penalty_batch_kl(spark, sf_dir):
    out = A.batch_kl(A.token_rewards(rollout_tokens(spark, sf_dir), 0.1), SEQ)
    return out.select(r6("current_kl"), "batch_size")


@query("seq_rewards", TOK + " SELECT event_id, round(score - (old_lp - ref_lp) * 0.05::DOUBLE, 6) + 0.0 AS reward FROM tok")
def seq_rewards(spark, sf_dir):
    t = rollout_tokens(spark, sf_dir)
    return t.select("event_id", r6(T.kl_shaped_reward(F.col("score"), F.col("old_lp"), F.col("ref_lp"), 0.05), "reward"))


STEPS_SQL = """steps AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step,
  avg(value) / 10 AS kl, count(*) AS n_steps FROM events GROUP BY ALL)"""


@query("kl_controller", "WITH RECURSIVE " + STEPS_SQL + """,
o AS (SELECT *, 1 + greatest(least(kl / 5 - 1, 0.2), -0.2) * n_steps / 1000.0::DOUBLE AS mult,
  row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM steps),
b AS (SELECT run, step, i, 0.2::DOUBLE AS beta, 0.2::DOUBLE * mult AS nxt FROM o WHERE i = 1
  UNION ALL SELECT o.run, o.step, o.i, b.nxt, b.nxt * o.mult FROM b JOIN o ON o.run = b.run AND o.i = b.i + 1)
SELECT run, step, round(beta, 8) AS beta, round(nxt, 8) AS beta_next FROM b""")
def kl_controller(spark, sf_dir):
    steps = (table(spark, sf_dir, "events")
             .groupBy(F.col("event_type").alias("run"),
                      F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("step"))
             .agg((F.avg("value") / 10).alias("kl"), F.count(F.lit(1)).alias("n_steps")))
    out = A.kl_controller(steps, ["run"], "step", "adaptive", 0.2, target=5.0, horizon=1000.0)
    return out.select("run", "step", F.round("beta", 8).alias("beta"), F.round("beta_next", 8).alias("beta_next"))


# ---------------------------------------------------------------- losses
POLICY_SQL = """, p AS (SELECT *, score - 20 AS adv, exp(lp - old_lp) AS ratio FROM tok),
q AS (SELECT *, -adv * ratio AS l1, -adv * least(greatest(ratio, 0.8::DOUBLE), 1.2::DOUBLE) AS l2 FROM p),
pl AS (SELECT uid, sample, sum(greatest(l1, l2) * mask) / nullif(sum(mask), 0) AS pg_loss,
  sum(CASE WHEN l2 > l1 THEN 1.0::DOUBLE ELSE 0 END * mask) / nullif(sum(mask), 0) AS pg_clipfrac,
  sum((old_lp - lp) * mask) / nullif(sum(mask), 0) AS ppo_kl,
  sum(abs(lp) * mask) / nullif(sum(mask), 0) AS entropy_loss,
  sum(greatest(least(exp(ref_lp - lp) - (ref_lp - lp) - 1, 10), -10) * mask) / nullif(sum(mask), 0) AS kl_loss
  FROM q GROUP BY uid, sample)"""


def _policy(spark, sf_dir):
    tokens = (rollout_tokens(spark, sf_dir).withColumn("advantage", F.col("score") - 20)
              .withColumn("entropy", F.abs("lp")))
    return T.policy_loss(tokens, SEQ, clip=0.2, kl_kind="low_var_kl")


@query("policy_loss", TOK + POLICY_SQL + """ SELECT uid, sample, coalesce(round(pg_loss, 6) + 0.0, -1) AS pg_loss,
coalesce(round(pg_clipfrac, 6), -1) AS pg_clipfrac, coalesce(round(ppo_kl, 6) + 0.0, -1) AS ppo_kl FROM pl""")
def policy_loss(spark, sf_dir):
    cols = [F.coalesce(r6(c), F.lit(-1.0)).alias(c) for c in ("pg_loss", "pg_clipfrac", "ppo_kl")]
    return _policy(spark, sf_dir).select(*SEQ, *cols)


@query("mask_by_kl_threshold", TOK + POLICY_SQL + """ SELECT round(avg(CASE WHEN kl_loss < 0.05 THEN pg_loss ELSE 0 END), 6)
AS policy_loss, round(1 - avg(CASE WHEN kl_loss >= 0.05 THEN 0 ELSE 1.0 END), 6) AS kl_masked_out_ratio FROM pl""")
def mask_by_kl_threshold(spark, sf_dir):
    per_seq = _policy(spark, sf_dir)
    kept = T.mask_by_kl(per_seq.withColumn("loss", F.col("pg_loss")), 0.05)
    return kept.agg(F.round(F.avg("loss"), 6).alias("policy_loss"),
                    F.round(1 - F.avg("kept"), 6).alias("kl_masked_out_ratio"))


@query("policy_diagnostics", TOK + POLICY_SQL + """, f AS (SELECT *, CASE WHEN kl_loss >= 0.05 THEN 0 ELSE 1.0::DOUBLE END AS keep,
 coalesce(pg_loss - entropy_loss * 0.001::DOUBLE + kl_loss * 0.01::DOUBLE, 0) AS loss FROM pl)
SELECT 'actor/policy_loss' AS metric, round(avg(loss * keep), 6) + 0.0 AS value FROM f UNION ALL
SELECT 'actor/entropy_loss', round(avg(entropy_loss), 6) FROM f UNION ALL
SELECT 'actor/pg_loss', round(avg(pg_loss), 6) + 0.0 FROM f UNION ALL
SELECT 'actor/pg_clipfrac', round(avg(pg_clipfrac), 6) FROM f UNION ALL
SELECT 'actor/ppo_kl', round(avg(ppo_kl), 6) + 0.0 FROM f UNION ALL
SELECT 'actor/kl_loss', round(avg(kl_loss), 6) FROM f UNION ALL
SELECT 'actor/kl_coef', 0.01::DOUBLE UNION ALL
SELECT 'actor/kl_masked_out_ratio', round(1 - avg(keep), 6) FROM f""")
def policy_diagnostics(spark, sf_dir):
    per_seq = _policy(spark, sf_dir)
    out = T.policy_diagnostics(per_seq, entropy_coeff=0.001, kl_coef=0.01, kl_threshold=0.05)
    return out.select("metric", r6("value"))


VALUE_SQL = """, v AS (SELECT *, val + (score - 20) / 10 AS vpred, score / 10 AS ret FROM tok),
w AS (SELECT *, power(vpred - ret, 2) AS a, power(greatest(least(vpred, val + 0.5), val - 0.5) - ret, 2) AS b FROM v)"""


def _values(spark, sf_dir, positions=False):
    t = rollout_tokens(spark, sf_dir, positions)
    return (t.withColumn("vpred", F.col("val") + (F.col("score") - 20) / 10)
            .withColumn("returns", F.col("score") / 10).withColumn("value", F.col("val")))


@query("value_loss", TOK + VALUE_SQL + """ SELECT round(0.5::DOUBLE * sum(greatest(a, b) * mask) / sum(mask), 6) AS vf_loss,
round(sum(CASE WHEN b > a THEN 1.0::DOUBLE ELSE 0 END * mask) / sum(mask), 6) AS vf_clipfrac FROM w""")
def value_loss(spark, sf_dir):
    return T.value_loss(_values(spark, sf_dir), clip=0.5).select(r6("vf_loss"), r6("vf_clipfrac"))


@query("critic_diagnostics", TOK + VALUE_SQL + """, s AS (SELECT *,
 lag(mask) OVER (PARTITION BY uid ORDER BY t) AS before FROM w), z AS (SELECT *, coalesce(before, 1) AS shifted FROM s)
SELECT 'critic/vf_loss' AS metric, round(0.5::DOUBLE * sum(greatest(a, b) * shifted) / sum(shifted), 6) AS value FROM z UNION ALL
SELECT 'critic/vf_clipfrac', round(sum(CASE WHEN b > a THEN 1.0::DOUBLE ELSE 0 END * shifted) / sum(shifted), 6) FROM z UNION ALL
SELECT 'critic/vpred_mean', round(sum(vpred * shifted) / sum(shifted), 6) FROM z""")
def critic_diagnostics(spark, sf_dir):
    tokens = T.shift_mask(_values(spark, sf_dir, positions=True), ["uid"], "t", "mask", first=1)
    return T.critic_diagnostics(tokens, clip=0.5).select("metric", r6("value"))


# ---------------------------------------------------------------- logits
LOGITS = """SELECT vec_id, label, [CAST(c AS DOUBLE) for c in embedding] AS x FROM embeddings"""
EMB = f"WITH e AS ({LOGITS}), s AS (SELECT *, list_max(x) AS m FROM e), l AS (SELECT *, m + ln(list_sum([exp(v - m) for v in x])) AS lse FROM s)"


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


@query("entropy_from_logits", EMB + """ SELECT vec_id, round(lse - list_sum([exp(v - lse) * v for v in x]), 6)
AS entropy FROM l""")
def entropy_from_logits(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", r6(L.entropy_from_logits(F.col("x")), "entropy"))


@query("entropy_loss", EMB + """, h AS (SELECT CASE WHEN label <> 3 THEN 1 ELSE 0 END AS mask,
 lse - list_sum([exp(v - lse) * v for v in x]) AS h FROM l)
SELECT round(sum(h * mask) / sum(mask), 6) AS entropy_loss FROM h""")
def entropy_loss(spark, sf_dir):
    mask = F.when(F.col("label") != 3, 1).otherwise(0)
    return _logits(spark, sf_dir).agg(
        r6(M.masked_mean(L.entropy_from_logits(F.col("x")), mask), "entropy_loss"))


@query("token_logprob", EMB + """, w AS (SELECT vec_id, x[label + 1] - lse AS lp,
 x[label + 1] / 2 - ln(list_sum([exp(v / 2) for v in x])) AS lp2 FROM l)
SELECT vec_id, round(lp, 6) AS logprob, round(lp2, 6) AS logprob_t2 FROM w""")
def token_logprob(spark, sf_dir):
    x, y = F.col("x"), F.col("label")
    return _logits(spark, sf_dir).select("vec_id", r6(L.token_logprob(x, y), "logprob"),
                                         r6(L.token_logprob(x, y, temperature=2.0), "logprob_t2"))


@query("response_logprob_slice", """WITH p AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS t, label,
  [CAST(c AS DOUBLE) for c in embedding] AS x, lead(label) OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) AS nxt,
  count(*) OVER (PARTITION BY vec_id // 16) AS n FROM embeddings)
SELECT seq, t, round(x[nxt + 1] - ln(list_sum([exp(v) for v in x])), 6) AS logprob FROM p
WHERE t >= n - 6 AND t < n - 1""")
def response_logprob_slice(spark, sf_dir):
    rows = _logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("t"),
                                         "label", "x")
    return T.response_logprobs(rows, ["seq"], "t", "label", "x", response_length=5).select("seq", "t", r6("logprob"))


@query("clip_by_value", "SELECT event_id, greatest(least(value, 30), 5) AS clipped FROM events")
def clip_by_value(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", L.clip_by_value(F.col("value"), 5.0, 30.0).alias("clipped"))


# ---------------------------------------------------------------- masks and positions
ORDERED = TOK + """, o AS (SELECT *, CASE WHEN event_id % 11 IN (3, 7) THEN 1 ELSE 0 END AS is_eos FROM tok)"""


@query("eos_mask", ORDERED + """ SELECT event_id, CASE WHEN coalesce(sum(is_eos) OVER (PARTITION BY uid ORDER BY t
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS eos_mask FROM o""")
def eos_mask(spark, sf_dir):
    tokens = rollout_tokens(spark, sf_dir, positions=True).withColumn("token", F.col("event_id") % 11)
    return T.eos_mask(tokens, ["uid"], "t", F.col("token").isin(3, 7)).select("event_id", "eos_mask")


@query("position_ids", TOK + """, c AS (SELECT *, sum(mask) OVER (PARTITION BY uid ORDER BY t) AS s FROM tok)
SELECT event_id, CAST(greatest(s - 1, 0) AS BIGINT) AS position_id, CAST((s - 1) * mask AS BIGINT) AS masked_position FROM c""")
def position_ids(spark, sf_dir):
    out = T.position_ids(rollout_tokens(spark, sf_dir, positions=True), ["uid"], "t", "mask")
    return out.select("event_id", "position_id", "masked_position")


LAST_SQL = """, c AS (SELECT *, sum(mask) OVER (PARTITION BY uid ORDER BY t) - 1 AS p FROM tok),
l AS (SELECT uid, arg_max(event_id, greatest(p, 0) * mask * 1000000 - t) AS event_id,
  arg_max(score, greatest(p, 0) * mask * 1000000 - t) AS score, arg_max(t, greatest(p, 0) * mask * 1000000 - t) AS t
  FROM c GROUP BY uid)"""


@query("last_valid_token", TOK + LAST_SQL + " SELECT uid, event_id, score, t FROM l")
def last_valid_token(spark, sf_dir):
    tokens = T.position_ids(rollout_tokens(spark, sf_dir, positions=True), ["uid"], "t", "mask")
    return T.last_valid_token(tokens, ["uid"], "t", "mask", ["event_id", "score"]).select("uid", "event_id", "score", "t")


@query("last_valid_token_expand", TOK + LAST_SQL + """ SELECT k.event_id, CASE WHEN k.t = l.t THEN l.score ELSE 0 END
AS token_score FROM tok k JOIN l USING (uid) WHERE k.t >= 3""")
def last_valid_token_expand(spark, sf_dir):
    tokens = T.position_ids(rollout_tokens(spark, sf_dir, positions=True), ["uid"], "t", "mask")
    last = T.last_valid_token(tokens, ["uid"], "t", "mask", ["score"])
    out = T.expand_to_tokens(tokens, last, ["uid"], "t", "score", response_start=3)
    return out.select("event_id", "token_score")


@query("place_outcome_reward", TOK + """, v AS (SELECT uid, sum(mask) AS n, max(t) AS last, sum(score) AS s FROM tok GROUP BY uid)
SELECT event_id, CASE WHEN t = CASE WHEN n = 0 THEN last ELSE n - 1 END THEN round(s, 6) ELSE 0 END AS reward
FROM tok JOIN v USING (uid)""")
def place_outcome_reward(spark, sf_dir):
    tokens = rollout_tokens(spark, sf_dir, positions=True)
    scores = rollout_tokens(spark, sf_dir).groupBy("uid").agg(F.sum("score").alias("outcome"))
    return T.place_outcome_reward(tokens, scores, ["uid"], "t", "mask", "outcome").select("event_id", r6("reward"))
