"""Plans that must hold at size: hot keys are split, big sides are shuffled once, nothing is crossed."""

import contextlib

from pyspark.sql import functions as F

from coppice.operators import joins
from coppice.operators import ordered as O
from coppice.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@contextlib.contextmanager
def conf(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString(), rows


def test_a_hot_group_is_split(spark):
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
              spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128KB", spark__sql__shuffle__partitions="16"):
        rows = spark.range(0, 300_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("k"),
                                                    (F.col("id") % 7).alias("v"))
        plan, out = final_plan(joins.with_group_stats(rows, ["k"], F.avg("v").alias("mean"), F.count("v").alias("n")))
        assert "skew=true" in plan
        assert len(out) == 300_000 and sum(r.n for r in out if r.id == 0) > 100_000


def test_positions_shuffle_the_rows_once(spark):
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        rows = spark.range(0, 1000, 1, 4).withColumn("payload", F.concat(F.lit("x"), F.col("id")))
        out = O.with_position(rows, [F.col("id")], O.id_bucket(F.col("id"), 100))
        plan = out._jdf.queryExecution().executedPlan().toString()
        carrying = [i for i, line in enumerate(plan.split("\n")) if "Exchange" in line
                    and "payload" in plan.split("\n")[i + 1]]
        assert len(carrying) == 1


def test_no_query_crosses_tables(spark):
    for name in ("masked_whiten", "adv_gae", "batch_repeat", "mini_batch_iter", "pad_to_divisor", "data_metrics", "timing_metrics",
                 "fanout_rollouts", "abstract_params", "augment_question_order", "pad_packed", "seqlen_balance_stats"):
        plan = catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_only_what_they_need(spark):
    plan = catalog.queries()["flops_estimate"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,source:string>" in plan and plan.count("FileScan") == 1
    plan = catalog.queries()["token_counts"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert all(f"EqualTo(role,{role})" in plan for role in ("user", "assistant"))
