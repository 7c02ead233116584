import itertools
import random

import pytest
from pyspark.sql import functions as F

from coppice.operators import balance, batch


def rows(spark, n):
    return spark.createDataFrame([(i, f"v{i}") for i in range(n)], "pos bigint, v string")


def test_divisibility_is_checked(spark):
    for bad in (lambda d: batch.batch_chunk(d, 3), lambda d: batch.fold_batch(d, 3, ["v"]), lambda d: batch.mini_batches(d, "pos", 3, 1)):
        with pytest.raises(Exception, match="not divisible"):
            bad(rows(spark, 10)).collect()


@pytest.mark.parametrize("n,divisor", [(3, 10), (7, 3), (6, 3), (1, 5)])
def test_pad_is_cyclic_and_unpad_undoes_it(spark, n, divisor):
    padded = batch.pad_to_divisor(rows(spark, n), divisor)
    got = {r.pos: r.v for r in padded.collect()}
    assert len(got) % divisor == 0 and got == {p: f"v{p % n}" for p in range(len(got))}
    assert batch.unpad(padded).count() == n


def test_union_conflict_and_missing_column(spark):
    left, right = rows(spark, 3), rows(spark, 3).withColumn("v", F.lit("other"))
    with pytest.raises(Exception, match="differs"):
        batch.batch_union(left, right, "pos").collect()
    assert batch.batch_conflicts(left, right, "pos").count() == 3
    with pytest.raises(KeyError):
        batch.batch_pop(left, "pos", ["nope"])
    with pytest.raises(ValueError):
        batch.batch_rename(left, ["v"], [])


def test_ragged_columns_are_an_error(spark):
    df = spark.createDataFrame([(1, [1, 2], [3])], "k int, a array<int>, b array<int>")
    with pytest.raises(Exception, match="ragged"):
        batch.columns_to_rows(df, ["k"], ["a", "b"]).collect()


def test_sample_per_source_with_a_hot_source(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(99).alias("src"))
    got = sorted((r.src, r.id) for r in batch.sample_per_source(df, "src", "id", 2).collect())
    want = sorted((s, i) for s in (0, 1, 2, 99) for i in [x for x in range(3000) if (x % 3 if x % 10 == 0 else 99) == s][:2])
    assert got == want


def test_differencing_known_case_and_equal_size():
    parts = balance.differencing_split([8, 7, 6, 5, 4], 2, False)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    rng = random.Random(0)
    for _ in range(30):
        k = rng.randint(2, 5)
        lengths = [rng.randint(1, 100) for _ in range(k * rng.randint(1, 8))]
        parts = balance.differencing_split(lengths, k, True)
        assert sorted(itertools.chain(*parts)) == list(range(len(lengths)))
        assert {len(p) for p in parts} == {len(lengths) // k} and all(p == sorted(p) for p in parts)
    with pytest.raises(ValueError):
        balance.differencing_split([1, 2, 3], 2, True)
    with pytest.raises(ValueError):
        balance.differencing_split([1], 2, False)


def test_greedy_takes_rows_in_input_order():
    assert balance.greedy_split([1, 5, 1, 1], 2, False) == [[0, 2, 3], [1]]
    assert balance.greedy_split([9, 1, 1, 1], 2, True) == [[0, 3], [1, 2]]


def test_micro_batches_respect_the_budget(spark):
    df = spark.createDataFrame([(0, i, 10 + i % 7) for i in range(40)], "batch_id bigint, pos bigint, length bigint")
    out = balance.micro_batches(df, 100, 50)
    parts = out.join(df, ["batch_id", "pos"]).groupBy("part").agg(F.sum("length").alias("s")).collect()
    assert len(parts) == -(-sum(10 + i % 7 for i in range(40)) // 100)
    with pytest.raises(ValueError):
        balance.micro_batches(df, 10, 50)


def test_snake_is_close_to_even(spark):
    df = spark.range(997).select("id", (F.col("id") * 37 % 113).alias("n"))
    sums = [r.s for r in balance.balance_snake(df, "id", F.col("n"), 7).groupBy("part").agg(F.sum("n").alias("s")).collect()]
    assert len(sums) == 7 and max(sums) - min(sums) <= 113
    assert balance.uneven_parts(balance.balance_snake(df.where("id < 994"), "id", F.col("n"), 7)).count() == 0
