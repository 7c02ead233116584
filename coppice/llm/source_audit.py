"""How far the sources of a language diverge in their use of words, in exact integers.

1. A term in ``minDF`` documents of a language is in as many of the table, so one ``CountVectorizer`` with that ``minDF``
   and the largest integer as ``vocabSize`` holds the vocabularies of all languages. Its sparse document vectors are
   brought together by language and source (a large group in several tasks) and summed, their non-zero entries counted
   too: a language keeps the terms whose entries, its exact document frequencies, reach ``minDF``.
2. A group gives a term p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), V terms of the language and N
   occurrences of them in the group.
3. The distance of two groups is the sum of |p - q| over all V terms. Terms that one or none of them has are not
   listed: with b the p of an absent term, the sum is V*|b - b'|, corrected per distinct p of either group and per
   term that both have.

A null text, language or source is empty. Rows are documents, repeated or not. A language without kept terms has
distances of 0; an empty table gives no rows. Other columns are ignored. The vocabulary (terms in ``minDF`` documents of
the table or more) passes through the driver, as it does in every ``CountVectorizer``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import ASCII_UPPER, only, written

TERM_GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
WHOLE_VOCABULARY = 2**31 - 1


def terms_of(text: str) -> Column:
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))
    return F.array_remove(F.split(lowered, TERM_GAP), "")


def share(count: Column, occurrences: str, terms: str) -> Column:
    """p of a term, by decimals: the product leaves 64 bits from 10^10 occurrences on."""
    part = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    whole = (F.col(occurrences) + F.col(terms) * PRIOR).cast("decimal(20,0)")
    return F.call_function("div", part, whole) + 1


def group_counts(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, docs) of (text, lang, source), summed from sparse document vectors; and (term, item)."""
    tokens = docs.select("lang", "source", terms_of("text").alias("terms"))
    never_empty = docs.sparkSession.range(min_docs).select(F.array(F.lit("")).alias("terms"))  # an empty vocabulary is refused
    frequent = CountVectorizer(inputCol="terms", outputCol="vector", minDF=min_docs, vocabSize=WHOLE_VOCABULARY)
    model = frequent.fit(tokens.select(F.array_distinct("terms").alias("terms")).unionByName(never_empty))  # only documents are counted
    vectors = model.transform(tokens).select("lang", "source", F.unwrap_udt("vector").alias("v"))
    vectors = vectors.select(F.xxhash64("lang", "source").alias("near"), "lang", "source", "v.indices", "v.values")
    # documents of a group are brought together as vectors, in tasks of a bounded size: most of their terms are then summed in the task
    vectors = vectors.hint("rebalance", F.col("near")).drop("near")
    entries = vectors.select("lang", "source", F.explode(F.arrays_zip(F.col("indices").alias("term"), F.col("values").alias("n"))).alias("e"))
    summed = entries.groupBy("lang", "source", F.col("e.term").alias("term")).agg(F.sum("e.n").cast("long").alias("n"), F.count(F.lit(1)).alias("docs"))
    shape = StructType([StructField("term", IntegerType()), StructField("item", StringType())])
    items = pd.DataFrame({"term": range(len(model.vocabulary)), "item": pd.Series(model.vocabulary, dtype=object)})
    return summed, docs.sparkSession.createDataFrame(items, shape)


def distances(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of groups of a language.

    ``groups``: lang, source, v, b. ``terms``: lang, source, term, p, b of the terms that a group has.
    """
    one, two = groups.alias("x"), groups.alias("y")
    absent = F.abs(F.col("x.b") - F.col("y.b"))
    pairs = one.join(two, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") != F.col("y.source")))
    bases = pairs.select("x.lang", "x.source", F.col("y.source").alias("item"), (F.col("x.v") * absent).alias("value"))
    held = terms.groupBy("lang", "source", "p", "b").agg(F.count(F.lit(1)).alias("k")).alias("x")
    against = held.join(two, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") != F.col("y.source")))
    alone = against.select("x.lang", "x.source", F.col("y.source").alias("item"), (F.col("x.k") * (F.abs(F.col("x.p") - F.col("y.b")) - absent)).alias("value"))
    left, right = terms.alias("x"), terms.alias("y")
    both = left.join(right, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.source") < F.col("y.source")))
    gained = (F.abs(F.col("x.p") - F.col("y.p")) - F.abs(F.col("x.p") - F.col("y.b")) - F.abs(F.col("x.b") - F.col("y.p")) + absent)
    common = both.groupBy("x.lang", F.col("x.source").alias("source"), F.col("y.source").alias("item")).agg(F.sum(gained).alias("value"))

    def swapped(df: DataFrame) -> DataFrame:
        return df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    parts = bases.unionByName(alone).unionByName(swapped(alone)).unionByName(common).unionByName(swapped(common))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources, and the ``top`` terms a source uses more than its language."""
    texts = only(docs, text, lang, source).toDF("text", "lang", "source").select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts, vocabulary = group_counts(texts, min_docs)
    counts = written(counts, "divergence-counts")
    per_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    counts = written(counts.drop("docs").join(per_lang, ["lang", "term"]), "divergence-kept")
    sizes = counts.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = written(groups.withColumn("b", F.when(F.col("v") > 0, share(F.lit(0), "total", "v")).otherwise(0)), "divergence-groups")
    terms = counts.join(groups, ["lang", "source"])
    terms = terms.select("lang", "source", "term", "b", share(F.col("n"), "total", "v").alias("p"), share(F.col("lang_n"), "lang_total", "v").alias("q"))
    terms = written(terms, "divergence-terms")
    pairs = distances(groups.select("lang", "source", "v", "b"), terms.select("lang", "source", "term", "p", "b"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    usual = terms.where("p > q").join(vocabulary, "term").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    usual = usual.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(usual.withColumn("part", F.lit("term")).select(columns))


AUDIT_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
used AS (SELECT r, lang, source, unnest(words) AS item FROM texts),
kept AS (SELECT lang, item FROM used GROUP BY ALL HAVING count(DISTINCT r) >= 30),
counts AS (SELECT lang, source, item, count(*)::HUGEINT AS n FROM used SEMI JOIN kept USING (lang, item) GROUP BY ALL),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
lang_counts AS (SELECT lang, item, sum(n) AS n FROM counts GROUP BY ALL),
lang_totals AS (SELECT lang, sum(n) AS total FROM lang_counts GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.item, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.v) AS p
    FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item),
usual AS (SELECT lang, item, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS q FROM lang_counts JOIN lang_totals USING (lang) JOIN sizes USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
every_pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, item, p - q AS value FROM shares JOIN usual USING (lang, item) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM every_pair UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 50
"""
