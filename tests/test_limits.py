"""Cases that a fixed length, depth or table size once got wrong."""

import pytest
from pyspark.sql import functions as F

from coppice.functions import rewards as R
from coppice.functions import tokens as K
from coppice.operators import tokenrows
from coppice.sources import readers


@pytest.mark.parametrize("a,b,equal", [
    ("x" * 1000 + "1", "x" * 1000, False), ("(((1)),2)", "(((1.0)),2)", True), ("((1),2)", "((1.0),2)", True),
    ("((((1))))", "((((1.0))))", True), ("((((1))))", "((((2.0))))", False), ("([1],2)", "((1.0),2)", False)])
def test_math_equal_is_not_cut(spark, a, b, equal):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(R.math_equal(F.col("a"), F.col("b")).alias("e")).first().e
    assert bool(got) is equal


@pytest.mark.parametrize("text,value", [
    ("2*(3+4)", 14.0), ("2*(3-5)^2", 8.0), ("-(1+2)*3", -9.0), ("((1+1)*(2+2))/4", 2.0), ("2^3+1", 9.0), ("1/0", None), ("2*(x+1)", None), ("(1", None),
    ("3 - 1 * 2", 1.0), ("~2", None)])
def test_arithmetic_with_parentheses(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(R.plain_arithmetic(F.col("t")).alias("v")).first().v == value


def test_expressions_of_pi(spark):
    rows = spark.createDataFrame([("2*(3+\\pi)", "12.283185307179586"), ("\\pi^2", "9.8696")], "a string, b string")
    got = [bool(r.e) for r in rows.select(R.math_equal(F.col("a"), F.col("b"), pi=F.lit("3.141592653589793")).alias("e")).collect()]
    assert got == [True, True]


def test_large_integers_are_graded(spark):
    rows = spark.createDataFrame([("1E40", "1e40"), ("1E30", "1e30"), ("1E40", "1e41")], "a string, b string")
    assert [r.g for r in rows.select(R.grade_answer(F.col("a"), F.col("b")).alias("g")).collect()] == [True, True, False]


def test_distinct_words_get_distinct_ids(spark):
    words = spark.range(300_000).select(F.concat(F.lit("w"), "id").alias("t"))
    assert words.select(K.tokenize(F.col("t"))[0].alias("i")).where("i >= 0").distinct().count() == 300_000


def test_flag_characters_in_a_text_stay(spark):
    text = "a\uffffb <<c\ufdd0d\ufdd1e>> \ufdd1 f"
    got = spark.createDataFrame([(text,)], "t string").select(K.content_token_mask(F.col("t")).alias("m")).first().m
    assert got.words == ["a\uffffb", "c\ufdd0d\ufdd1e", "\ufdd1", "f"] and got.inside == [False, True, False, False]


def test_set_names_are_decoded(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/my set+1.parquet")
    assert {r.set_name for r in readers.read_named_sets(spark, [f"{tmp_path}/my set+1.parquet"], "id bigint").collect()} == {"my set+1"}


def test_empty_sequences_count_as_kept(spark):
    rows = spark.createDataFrame([(1.0, 0.01), (3.0, 0.9), (None, None)], "loss double, kl_loss double")
    got = tokenrows.mask_by_kl(rows, 0.05).agg(F.sum("loss").alias("s"), F.avg("kept").alias("k"), F.count("loss").alias("n")).first()
    assert (got.s, round(got.k, 6), got.n) == (1.0, 0.666667, 3)
