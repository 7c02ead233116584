"""Numbering, encoding and decoding by vocabulary tables."""

import pytest

from coppice.operators import vocabulary as V

TEXTS = [(1, "b a  a\n"), (2, "a b <pad> a"), (3, ""), (4, None), (5, "é a é"), (6, "   "), (7, "x " * 3000)]


def test_ids_are_dense_and_by_frequency(spark):
    rows = V.build(spark.createDataFrame(TEXTS, "id long, text string")).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows))) and [r.token for r in rows[:3]] == list(V.RESERVED)
    order = [(-r.n, r.token.encode()) for r in rows[3:]]
    assert order == sorted(order) and {r.token for r in rows[3:]} >= {"a", "\n", "a b", "<pad>", "   "}


def test_texts_come_back(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    known = V.build(texts)
    encoded = V.encode(texts, known, "id")
    assert {r.id: r.text for r in V.decode(encoded, known, "id").collect()} == dict(TEXTS)
    ids = {r.id: r.ids for r in encoded.collect()}
    assert ids[3] == [] and ids[4] is None and V.PAD not in ids[2]


def test_unknown_pieces_and_ids(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    known = V.build(texts.where("id = 1"))
    assert {r.id: r.text for r in V.decode(V.encode(texts.where("id = 5"), known, "id"), known, "id").collect()} == {5: "<unk> a <unk>"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        V.decode(spark.createDataFrame([(1, [999])], "id long, ids array<long>"), known, "id").collect()
    assert V.encode(texts.limit(0), known, "id").isEmpty() and V.build(texts.limit(0)).count() == len(V.RESERVED)


def test_folds_in_chunks(spark):
    from coppice.operators import batch
    rows = spark.range(60).selectExpr("id AS pos", "id * 2 AS v")
    folded = batch.fold_batch(rows, 3, ["v"], largest=8)
    assert sorted((r.fold, r.chunk, len(r.rows)) for r in folded.collect()) == [(f, c, n) for f in range(3) for c, n in ((0, 8), (1, 8), (2, 4))]
    assert sorted(map(tuple, batch.unfold_batch(folded, ["v"]).collect())) == [(i, 2 * i) for i in range(60)]
