"""Exchanges of whole conversations and packing per training batch against plain Python."""

from pyspark.sql import functions as F

from coppice.operators import records
from coppice.operators import tokenise as T


def test_every_exchange_of_a_conversation(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "assistant", "d"), (1, 5, "user", "e"),
            (2, 0, "assistant", "x"), (2, 1, "assistant", "y"), (3, 0, "user", None), (3, 1, "assistant", "z"), (4, 0, "user", "q"), (4, 2, "assistant", "late")]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    got = {tuple(r) for r in records.exchanges(turns, "conv", "turn", "role", "text").collect()}
    assert got == {(1, 2, "a", "b"), (1, 4, "c", "d"), (3, 1, None, "z")}
    assert records.exchanges(turns.limit(0), "conv", "turn", "role", "text").isEmpty()


def test_packing_by_batch(spark):
    masks = {(0, 0): [0, 1, 1, 0], (0, 1): [1, 1, 1, 1], (1, 0): [0, 0, 1], (1, 1): [0, 0, 0], (1, 2): [1, 1, 0]}
    df = spark.createDataFrame([(b, p, m) for (b, p), m in masks.items()], "b long, pos long, m array<long>")
    indices, cumulative = T.pack_sequences(df, "pos", "m", ["b"])
    assert {(r.b, r["index"]) for r in indices.collect()} == {(b, p * len(m) + i) for (b, p), m in masks.items() for i, x in enumerate(m) if x}
    assert {tuple(r) for r in cumulative.collect()} == {(0, 0, 0), (0, 1, 2), (0, 2, 6), (1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 3)}
    padded, longest = T.pad_packed(cumulative, T.longest_packed(df, "m", ["b"]), 6, ["b"])
    assert {tuple(r) for r in padded.where("pos > 2").collect()} == {(1, 3, 3), (1, 4, 6)}
    assert {tuple(r) for r in longest.collect()} == {(0, 4, 0), (1, 3, 3)}


def test_packing_of_one_batch(spark):
    df = spark.createDataFrame([(0, [1, 1, 0]), (1, [0, 1, 1])], "pos long, m array<long>")
    indices, cumulative = T.pack_sequences(df, "pos", "m")
    assert sorted(r["index"] for r in indices.collect()) == [0, 1, 4, 5]
    padded, longest = T.pad_packed(cumulative, T.longest_packed(df, "m"), 8)
    assert sorted(tuple(r) for r in padded.collect()) == [(0, 0), (1, 2), (2, 4), (3, 8)]
    assert longest.select(F.col("max_seqlen"), F.col("pad_size")).first() == (4, 4)
