import datetime as dt

import pandas as pd
import pytest

from coppice.session import scratch_path
from coppice.streaming import jobs

SCHEMA = "uid bigint, rid bigint, score double, ts timestamp"


def write(spark, path, rows):
    frame = pd.DataFrame(rows, columns=["uid", "rid", "score", "ts"])
    spark.createDataFrame(frame, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_groups_wait_for_all_responses_across_restarts_and_time_out(spark):
    base = scratch_path(spark, "test-groups")
    at = dt.datetime(2024, 1, 1)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        out = jobs.group_advantage_stream(stream, "uid", "rid", "score", "ts", group_size=3, timeout_ms=60_000, delay="10 seconds")
        (out.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True)
         .start(f"{base}/out").awaitTermination())
        return {r.row_id: r for r in spark.read.parquet(f"{base}/out").collect()}

    write(spark, f"{base}/in", [(1, 10, 1.0, at), (1, 11, 2.0, at), (2, 20, 5.0, at)])
    assert run() == {}
    write(spark, f"{base}/in", [(1, 12, 3.0, at + dt.timedelta(seconds=5))])
    first = run()
    assert sorted(first) == [10, 11, 12] and first[10].advantage == pytest.approx(-1.0, abs=1e-4)
    write(spark, f"{base}/in", [(3, 30, 1.0, at + dt.timedelta(hours=1))])
    late = run()
    assert late[20].n == 1 and late[20].advantage == pytest.approx(5.0, abs=1e-4)


def test_surplus_responses_are_refused(spark):
    base = scratch_path(spark, "test-surplus")
    at = dt.datetime(2024, 1, 1)
    write(spark, f"{base}/in", [(1, i, float(i), at) for i in range(4)])
    stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
    with pytest.raises(Exception, match="more than 3 responses"):
        jobs.run_available(jobs.group_advantage_stream(stream, "uid", "rid", "score", "ts", group_size=3), "surplus")


def test_controller_state_survives_a_restart(spark):
    base = scratch_path(spark, "test-kl")
    schema = "run string, step bigint, kl double, n_steps bigint"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        steps = spark.readStream.schema(schema).parquet(f"{base}/in")
        (jobs.kl_controller_stream(steps, 0.2, 5.0, 100.0).writeStream.format("parquet").option("checkpointLocation", f"{base}/ck")
         .trigger(availableNow=True).start(f"{base}/out").awaitTermination())
        return {r.step: r for r in spark.read.parquet(f"{base}/out").collect()}

    run([("a", 1, 10.0, 10), ("a", 0, 1.0, 10)])
    got = run([("a", 2, 5.5, 10)])
    beta = 0.2
    for step, kl in enumerate([1.0, 10.0, 5.5]):
        assert got[step].beta == pytest.approx(beta)
        beta *= 1 + max(min(kl / 5.0 - 1, 0.2), -0.2) * 10 / 100.0
    assert got[2].beta_next == pytest.approx(beta)
