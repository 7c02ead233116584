"""Jobs whose cost once grew faster than their input, or that were cut to hold it down."""

import time

from pyspark.sql import functions as F

from coppice.operators import batch, scoring


def test_fanned_out_prompts_are_not_broadcast(spark):
    prompts = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (3, "c")], "uid long, m string")
    responses = spark.createDataFrame([(1, 0, "x"), (1, 9, "y"), (1, 10, "no"), (1, -1, "no"), (None, 2, "z"), (2, 1, "no"), (1, None, "no")],
                                      "uid long, sample int, r string")
    out = batch.fanout_rollouts(prompts, responses, "uid", 10)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["uid", "m", "sample", "r"] and dict(out.dtypes)["sample"] == "int"
    assert sorted(map(tuple, out.where("uid is not null").collect())) == [(1, "a", 0, "x"), (1, "a", 0, "x"), (1, "a", 9, "y"), (1, "a", 9, "y")]
    assert list(map(tuple, out.where("uid is null").collect())) == [(None, "n", 2, "z")]


def test_a_reward_is_placed_in_one_pass(spark):
    rows = spark.range(0, 4, 1, 4).select(F.array_repeat(F.lit(1).cast("bigint"), 60_000).alias("mask"), F.lit(2.0).alias("score"))
    start = time.monotonic()
    placed = rows.select(scoring.placed_reward(F.col("mask"), F.col("score")).alias("p")).select(F.element_at("p", -1).alias("last"), F.size("p").alias("n"))
    assert [tuple(r) for r in placed.collect()] == [(2.0, 60_000)] * 4
    assert time.monotonic() - start < 30


def test_folds_are_whole(spark):
    folded = batch.fold_batch(spark.range(9000).selectExpr("id AS pos", "id * 2 AS v"), 3, ["v"])
    assert folded.columns == ["fold", "rows"]
    rows = sorted((r.fold, [(x.pos, x.v) for x in r.rows]) for r in folded.collect())
    assert rows == [(f, [(i, 2 * i) for i in range(3000 * f, 3000 * f + 3000)]) for f in range(3)]


def test_closures_are_counted_with_their_budget(spark):
    from coppice.operators import structure as S
    up = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "b", "c"), (1, "a", "c")], "problem_id long, child string, parent string")
    roots = spark.createDataFrame([(1, "a")], "problem_id long, node string")
    degrees = up.groupBy("problem_id", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = S.closure_budget(S.ancestor_closure(roots, up, max_depth=3), degrees, used_ops=0, max_ops=9, size="n_nodes")
    assert [r.asDict() for r in out.collect()] == [{"problem_id": 1, "root": "a", "new_ops": 4, "n_nodes": 3, "accepted": 1}]


def test_a_grade_is_one_value(spark):
    from coppice.functions import rewards as R
    rows = spark.createDataFrame([("Step 2: so \\boxed{3}", "3"), ("the answer is 4", "5")], "a string, b string")
    out = rows.select(R.math_verdict(F.col("a"), F.col("b")).alias("v")).select("v.correct", "v.format_ok", "v.answer")
    assert [tuple(r) for r in out.collect()] == [(True, True, "3"), (False, False, "4")]


def test_an_answer_is_graded_once_for_both_fields(spark):
    from coppice.functions import rewards as R
    rows = spark.createDataFrame([("Step 2: so \\boxed{ 3\u3000}", "3"), ("the answer is Interval(1, 2)", "[1.0, 2]"), ("it is 1,234 cm", "1234"),
                                  ("The ANSWER IS \\frac12", "0.5"), ("we get 7\u00a0", "8"), (None, "1")], "a string, b string")
    out = rows.select(R.math_verdict(F.col("a"), F.col("b")).alias("v"))
    assert out._jdf.queryExecution().analyzed().toString().count("(\\p{L})") == 1  # the pattern of the guard
    assert [tuple(r) for r in out.select("v.correct", "v.format_ok", "v.answer").collect()] == [
        (True, True, "3"), (True, False, "Interval(1, 2)"), (True, True, "1,234 cm"), (True, True, "\\frac12"), (False, False, "7"), (False, None, None)]
    plan = rows.repartition(7, "a").select(R.match_answer(F.col("a"))["matched"].alias("m"))
    assert [r.m for r in plan.orderBy("a").collect()][0] is None

def test_texts_are_encoded_without_a_row_per_occurrence(spark):
    from coppice.operators import vocabulary as V
    texts = spark.createDataFrame([(1, "a b a")], "id long, text string")
    plan = V.encode(texts, spark.createDataFrame([("a", 3)], "token string, id long"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan
