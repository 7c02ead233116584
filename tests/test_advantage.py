import statistics

import pytest
from pyspark.sql import functions as F

from coppice.functions import losses as L
from coppice.operators import advantage as A
from coppice.operators import metrics as M
from coppice.operators import tokenrows as T

SCHEMA = "uid int, sample int, t int, reward double, value double, mask int"


def tokens(spark):
    rows = [(1, s, t, float(s * 3 + t), float(t % 2), 1 if t < 3 else 0) for s in range(3) for t in range(4)]
    rows += [(2, 9, t, 1.0, 0.5, 1) for t in range(3)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def scores(rows):
    out = {}
    for u, s, _, r, _, _ in rows:
        out[(u, s)] = out.get((u, s), 0) + r
    return out


def test_grpo_single_sample_and_equal_scores(spark):
    rows, df = tokens(spark)
    got = {(r.uid, r.sample, r.t): r.advantage for r in A.grpo(df, ["uid"], ["uid", "sample"]).collect()}
    score = scores(rows)
    group = [v for (u, _), v in score.items() if u == 1]
    for u, s, t, _, _, m in rows:
        mean, std = (statistics.mean(group), statistics.stdev(group)) if u == 1 else (0.0, 1.0)
        assert got[(u, s, t)] == pytest.approx((score[(u, s)] - mean) / (std + 1e-6) * m)
    flat = spark.createDataFrame([(1, s, 0, 2.0, 0.0, 1) for s in range(4)], SCHEMA)
    assert all(r.advantage == 0 for r in A.grpo(flat, ["uid"], ["uid", "sample"]).collect())


def test_rloo_single_sample_keeps_score(spark):
    rows, df = tokens(spark)
    got = {(r.uid, r.sample): r.advantage for r in A.rloo(df, ["uid"], ["uid", "sample"]).where("mask = 1").collect()}
    score = scores(rows)
    assert got[(2, 9)] == pytest.approx(score[(2, 9)])
    others = [v for (u, s), v in score.items() if u == 1 and s != 2]
    assert got[(1, 2)] == pytest.approx(score[(1, 2)] - statistics.mean(others))


@pytest.mark.parametrize("block", [2, 1024])
def test_gae_and_reinforce_match_the_backward_loop(spark, block):
    rows, df = tokens(spark)
    gamma, lam = 0.9, 0.7
    raw, ret_gae, ret_rpp = {}, {}, {}
    for seq in {(r[0], r[1]) for r in rows}:
        nxt = adv = run = 0.0
        for u, s, t, r, v, m in sorted((r for r in rows if (r[0], r[1]) == seq), key=lambda r: -r[2]):
            adv = r + gamma * nxt - v + gamma * lam * adv
            nxt = v
            run = r + gamma * run
            raw[(u, s, t)], ret_gae[(u, s, t)], ret_rpp[(u, s, t)] = adv, adv + v, run
            run *= m
    keep = [(u, s, t) for u, s, t, _, _, m in rows if m]
    mean, var = statistics.mean(raw[k] for k in keep), statistics.variance([raw[k] for k in keep])
    for r in A.gae(df, ["uid", "sample"], gamma=gamma, lam=lam, block=block).collect():
        key = (r.uid, r.sample, r.t)
        assert r.returns == pytest.approx(ret_gae[key])
        assert r.advantage == pytest.approx((raw[key] - mean) / (var + 1e-8) ** 0.5)
    for r in A.reinforce_pp(df, ["uid", "sample"], gamma=gamma, block=block).collect():
        assert r.returns == pytest.approx(ret_rpp[(r.uid, r.sample, r.t)])
        assert r.mask == 1 or r.advantage == 0


def test_unknown_names_are_errors(spark):
    _, df = tokens(spark)
    with pytest.raises(NotImplementedError):
        A.advantage(df, "nope", ["uid"])
    with pytest.raises(NotImplementedError):
        L.kl_penalty(F.col("a"), F.col("b"), "full")
    with pytest.raises(ValueError):
        A.kl_controller(df, ["uid"], "t", "nope", 0.1)


def test_no_reference_means_no_penalty(spark):
    df = spark.createDataFrame([(1, 2.0, 1)], "uid int, score double, mask int")
    row = A.token_rewards(df, 0.5, has_reference=False).first()
    assert (row.kld, row.reward) == (0.0, 2.0)


def test_kl_controller_survives_negative_multipliers(spark):
    steps = [("r", i, 0.0 if i % 2 else 50.0, 40) for i in range(12)]
    df = spark.createDataFrame(steps, "run string, step int, kl double, n_steps int")
    beta = 0.2
    for row in A.kl_controller(df, ["run"], "step", "adaptive", 0.2, target=5.0, horizon=4.0).orderBy("step").collect():
        assert row.beta == pytest.approx(beta)
        beta *= 1 + max(min(row.kl / 5.0 - 1, 0.2), -0.2) * 40 / 4.0
        assert row.beta_next == pytest.approx(beta)


def test_masked_aggregates_edges(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "v double, m int")
    assert df.agg(M.masked_mean(F.col("v"), F.col("m")).alias("x")).first().x is None
    with pytest.raises(Exception, match="at least two"):
        df.agg(M.masked_var(F.col("v"), F.col("m"))).collect()


def test_place_outcome_reward_wraps_without_valid_tokens(spark):
    df = spark.createDataFrame([(1, t, 0) for t in range(3)] + [(2, t, int(t < 2)) for t in range(3)], "uid int, t int, mask int")
    s = spark.createDataFrame([(1, 5.0), (2, 7.0)], "uid int, outcome double")
    got = {(r.uid, r.t): r.reward for r in T.place_outcome_reward(df, s, ["uid"], "t", "mask", "outcome").collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 5.0, (2, 0): 0, (2, 1): 7.0, (2, 2): 0}


def test_eos_mask_example(spark):
    ids = [0, 0, 2, 42, 3, 5, 1, 0, 0]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(ids)], "s int, t int, x int")
    got = [r.eos_mask for r in T.eos_mask(df, ["s"], "t", F.col("x").isin(1)).orderBy("t").collect()]
    assert got == [1, 1, 1, 1, 1, 1, 1, 0, 0]


def test_device_and_flops_unknown(spark):
    row = spark.range(1).select(M.device_peak(F.lit("RTX")).alias("p"),
                                M.flops_estimate({"model_type": "x"}, F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("f")).first()
    assert row.p == float("inf") and row.f == 0
