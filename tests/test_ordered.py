import random

import pytest
from pyspark.sql import functions as F

from coppice.operators import ordered as O


def hot_rows(seed=3, hot=400, groups=5):
    """One group holds most of the rows."""
    rng = random.Random(seed)
    sizes = {0: hot, **{g: rng.randint(1, 9) for g in range(1, groups)}}
    return [(g, t, rng.uniform(-1, 1), rng.choice([0.0, 0.5, 0.9])) for g, n in sizes.items() for t in range(n)]


@pytest.mark.parametrize("block,reverse", [(4, True), (4, False), (7, True), (1024, True)])
def test_linear_recurrence_spans_blocks(spark, block, reverse):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g int, t int, b double, a double")
    got = {(r.g, r.t): r.y for r in O.linear_recurrence(
        df, ["g"], "t", F.col("a"), F.col("b"), "y", reverse=reverse, init=0.25, block=block).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        y = 0.25
        for _, t, b, a in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=reverse):
            assert got[(g, t)] == pytest.approx(y, abs=1e-9)
            y = b + a * y


@pytest.mark.parametrize("reverse,inclusive", [(False, True), (False, False), (True, True), (True, False)])
def test_running_total_spans_buckets(spark, reverse, inclusive):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g int, t int, b double, a double")
    out = O.running_total(df, F.col("b"), [F.col("t")], F.floor(F.col("t") / 16), ["g"], "s", reverse, inclusive)
    got = {(r.g, r.t): r.s for r in out.collect()}
    for g, t, b, _ in rows:
        same = [r for r in rows if r[0] == g and (r[1] > t if reverse else r[1] < t)]
        assert got[(g, t)] == pytest.approx(sum(r[2] for r in same) + (b if inclusive else 0), abs=1e-9)


def test_position_is_dense_across_buckets_and_nulls(spark):
    df = spark.createDataFrame([(k, i) for k in (1, None) for i in range(100)], "k int, i int")
    out = O.with_position(df, [F.col("i")], F.floor(F.col("i") / 7), ["k"], total="n").collect()
    assert len(out) == 200
    assert all(r.pos == r.i and r.n == 100 for r in out)


def test_global_position_is_not_one_task(spark):
    df = spark.range(0, 1000, 1, 4)
    key = O.seeded_key(1, F.col("id"))
    out = O.with_position(df, [key, F.col("id")], O.hash_bucket(key))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert sorted(r.pos for r in out.collect()) == list(range(1000))


def test_too_small_bound_is_an_error(spark):
    df = spark.createDataFrame([(1, t, 1.0) for t in range(40)], "g int, t int, b double")
    with pytest.raises(Exception, match="max_len"):
        O.linear_recurrence(df, ["g"], "t", F.lit(0.5), F.col("b"), "y", block=4, max_len=4).collect()
