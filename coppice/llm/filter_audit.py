"""How five text filters interact, over every order of applying them.

1. One pass over the texts gives a narrow row per document: key, part, text hash and the failed filters A to D as bits.
2. A text hash that two different keys share makes its documents suspects. A left-semi join of the suspects with the
   smallest key of each of their texts, on hash, exact text and smaller key, is filter E.
3. The ids of E are united with the other failures and merged per document; documents are counted by part, failed
   filters and labels, so that the orders are played through on a few counts only.

A document is a row: repeated rows count as often as they occur. A null text is empty, a null part the empty string. A
null key is smaller than none and has no smaller one and no label; a key labelled twice is good (toxic) if any of its
labels says so. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, whole_text, written

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Hashes that are sent to every task (16 bytes each); beyond them the suspects are found by a shuffle.
SMALL_SIDE = 1_000_000
#: A text held by more than this share of the rows is spread over several pieces of the semi-join.
PIECE_SHARE = 1000


def failed_bits(text: str) -> Column:
    """Filters A to D that the text fails, as bits 1, 2, 4 and 8."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [F.size(words) < 100,
              F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
              capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
              F.col(text).rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def later_copies(texts: DataFrame, hashes: DataFrame, rows: int) -> DataFrame:
    """(id, part, h) of the rows of (id, part, text, h) whose text a smaller id has too; ``hashes`` holds every (id, h)."""
    piece = max(1, rows // PIECE_SHARE)
    shared = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = written(shared.select(F.col("h").alias("of"), F.ceil(F.col("n") / piece).cast("int").alias("pieces")), "audit-shared")
    few = shared.count() <= SMALL_SIDE
    suspects = texts.join(F.broadcast(shared) if few else shared, F.col("h") == F.col("of")).drop("of")
    holders = suspects.groupBy("h", "text").agg(F.min("id").alias("first"), F.max("pieces").alias("pieces"))
    holders = holders.select("h", "text", "first", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).alias("b")
    spread = suspects.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).alias("a")
    smaller = (F.col("a.h") == F.col("b.h")) & (F.col("a.text") == F.col("b.text")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("b.first") < F.col("a.id"))
    return spread.join(holders, smaller, "left_semi").select("id", "part", "h")


def failure_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, fails, n, good, toxic): documents, and of them the good and the toxic, by the letters of the failed filters."""
    texts = only(docs, key, text, part).toDF("id", "text", "part").select(
        "id", whole_text().alias("text"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    narrow = written(texts.select("id", "part", "h", failed_bits("text").alias("bits")), "audit-bits")
    copies = later_copies(texts, narrow.select("id", "h"), narrow.count())
    failures = narrow.withColumn("n", F.lit(1)).unionByName(copies.withColumn("bits", F.lit(1 << 4)).withColumn("n", F.lit(0)))
    merged = failures.groupBy("id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    fails = F.concat(*[F.when(F.col("bits").bitwiseAND(1 << i) > 0, name).otherwise("") for i, name in enumerate(FILTERS)])
    merged = merged.select("id", "part", fails.alias("fails"), "n")
    marks = only(labels, key, "quality", "toxic").toDF("of", "quality", "toxic").where("quality = 1 or toxic = 1").groupBy("of").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("bad"))
    unmarked = merged.where("id is null").withColumn("good", F.lit(0)).withColumn("bad", F.lit(0))
    marked = merged.where("id is not null").join(marks, F.col("id") == F.col("of"), "left").drop("of").fillna(0, ["good", "bad"])
    return marked.unionByName(unmarked).groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there."""
    counts = failure_counts(docs, labels, key, text, part)
    orders = counts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ",")))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("before", F.expr("left(filter_order, step - 1)"))
    gone = F.expr("translate(before, fails, '') <> before")
    hit = F.expr("contains(fails, letter)")
    here = hit & ~gone

    def total(of: Column, of_what: str = "n") -> Column:
        return F.sum(F.when(of, F.col(of_what)).otherwise(0)).cast("long")

    share = F.col("n") * (F.lit(len(ORDERS)) / F.length("fails")).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~hit & ~gone).alias("kept"), total(here).alias("removed"), total(hit & gone).alias("redundant"),
        total(F.col("fails") == F.col("letter")).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        F.sum(F.when(hit, share).otherwise(0)).cast("long").alias("shapley"))


AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY text) AS first FROM texts),
failed AS (SELECT doc_id, part,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * capitals > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails FROM worded),
marked AS (SELECT part, fails,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad FROM failed),
counts AS (SELECT part, fails, good, bad, count(*) AS n FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
played AS (SELECT *, contains(fails, letter) AS hit, translate(before, fails, '') <> before AS gone FROM counts, steps)
SELECT part, filter_order, step::INTEGER AS step,
    coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (hit AND NOT gone AND bad), 0)::BIGINT AS toxic_lost,
    sum(sum(n) FILTER (hit AND NOT gone)) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM played GROUP BY part, filter_order, step, letter
"""
