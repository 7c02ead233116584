"""Sources and sinks: everything written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..schemas import RL_RECORD
from ..session import scratch_path
from ..sources import readers, sinks
from .batches import RAW
from .common import bound, plain, query, table
from .statistics import EVAL, METRIC_ROWS

ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def order_files(spark, sf_dir, name):
    """Orders as sets, one path per status that occurs, by name."""
    base = scratch_path(spark, name)
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    statuses = sorted(r[0] for r in orders.select("o_orderstatus").distinct().collect())
    for status in statuses:
        sinks.write_records(orders.where(F.col("o_orderstatus") == status), f"{base}/status_{status}.parquet")
    return [f"{base}/status_{s}.parquet" for s in statuses]


@query("scan_parquet_multi", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_parquet_multi(spark, sf_dir):
    return readers.read_tables(spark, order_files(spark, sf_dir, "multi"), ORDER_SCHEMA)


@query("file_concat", "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus")
def file_concat(spark, sf_dir):
    paths = order_files(spark, sf_dir, "concat")
    return readers.read_tables(spark, paths, ORDER_SCHEMA).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("scan_splits", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'val' ELSE 'train' END AS split FROM orders")
def scan_splits(spark, sf_dir):
    paths = order_files(spark, sf_dir, "splits")
    return readers.read_splits(spark, {"train": [p for p in paths if "status_P" not in p], "val": [p for p in paths if "status_P" in p]}, ORDER_SCHEMA).select("o_orderkey", "split")


@query("scan_named_sets", "SELECT 'status_' || o_orderstatus AS set_name, count(*) AS n FROM orders GROUP BY 1")
def scan_named_sets(spark, sf_dir):
    sets = readers.read_named_sets(spark, order_files(spark, sf_dir, "sets"), ORDER_SCHEMA)
    return sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("n"))


@query("sink_parquet", f"SELECT query AS content1, CAST(final_answer AS VARCHAR) AS ground_truth, num_ops, response AS answer FROM ({plain(RAW)})")
def sink_parquet(spark, sf_dir):
    path = scratch_path(spark, "records")
    sinks.write_records(records.shape_rl_record(bound(spark, sf_dir, RAW)), path)
    back = readers.read_tables(spark, path, RL_RECORD)
    return back.select(F.col("prompt")[1]["content"].alias("content1"), "reward_model.ground_truth", "extra_info.num_ops", "extra_info.answer")


@query("sink_generations_json", """SELECT 'all' AS kept, p_partkey, p_name AS completion, p_size % 3 AS reward FROM part
UNION ALL SELECT 'first', p_partkey, p_name, p_size % 3 FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 25)""")
def sink_generations_json(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("completion"), (F.col("p_size") % 3).alias("reward"))
    out = None
    for kept, limit in (("all", -1), ("first", 25)):
        path = scratch_path(spark, "generations")
        sinks.write_generations(rows, path, "p_partkey", limit)
        back = spark.read.schema(rows.schema).json(path).select(F.lit(kept).alias("kept"), "p_partkey", "completion", "reward")
        out = back if out is None else out.unionByName(back)
    return out


@query("sink_accuracy_report", f"SELECT printf('%.4f', avg(reward)) AS value FROM ({plain(EVAL)})")
def sink_accuracy_report(spark, sf_dir):
    path = scratch_path(spark, "accuracy")
    sinks.write_accuracy_report(bound(spark, sf_dir, EVAL), path)
    return spark.read.text(path)


@query("sink_dataset_config", "SELECT count(*) AS dataset_size, min(p_partkey % 11 + 15) AS min_operations, max(p_partkey % 11 + 15) AS max_operations FROM part")
def sink_dataset_config(spark, sf_dir):
    path = scratch_path(spark, "config")
    config = bound(spark, sf_dir, RAW).agg(F.count(F.lit(1)).alias("dataset_size"), F.min("num_ops").cast("bigint").alias("min_operations"),
                                           F.max("num_ops").cast("bigint").alias("max_operations"))
    sinks.write_dataset_config(config, path)
    return spark.read.schema("dataset_size bigint, min_operations bigint, max_operations bigint").json(path)


@query("batch_roundtrip", "SELECT vec_id, label, len(embedding) AS width, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 6) AS total FROM embeddings")
def batch_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "batch")
    sinks.save_batch(table(spark, sf_dir, "embeddings"), path)
    back = readers.load_batch(spark, path, "vec_id bigint, embedding array<float>, label int")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", "label", F.size("embedding").cast("bigint").alias("width"), F.round(total, 6).alias("total"))


@query("raw_dataset_io", f"SELECT query, response, num_ops, final_answer, response_with_mask FROM ({plain(RAW)})")
def raw_dataset_io(spark, sf_dir):
    path = scratch_path(spark, "raw")
    sinks.write_records(bound(spark, sf_dir, RAW).drop("p_partkey"), path)
    return readers.read_raw_problems(spark, path)


@query("metrics_sink", f"SELECT run, step, metric, round(max(value), 6) AS value FROM ({plain(METRIC_ROWS)}) GROUP BY ALL")
def metrics_sink(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    rows = bound(spark, sf_dir, METRIC_ROWS).groupBy("run", "step", "metric").agg(F.round(F.max("value"), 6).alias("value"))
    sinks.log_metrics(rows.where("step < 10"), path)
    sinks.log_metrics(rows.where("step >= 10"), path)
    return readers.read_metrics(spark, path)
