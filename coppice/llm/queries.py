"""The bound queries of the corpus operators and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_pairs, decontaminate, filter_audit, html_text, licences, mixing, neardup, outliers, quality, secrets, sharding,
               source_audit, toxicity)
from .common import fold, only, table, whole_text, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 40


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang")
    topical = docs.withColumn("topic", mixing.topic_of(whole_text()))
    return mixing.mix(topical, "doc_id", "text", ["source", "lang", "topic"]).select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


@query("op2_scan_licences")
def scan_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op4_shard")
def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    narrow = sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"), "shard", "grown_shard")
    return sharding.number_slots(narrow, "shard", ["doc_id", "size", "text_crc32", "grown_shard"]).withColumn("law", F.lit("key"))


@query("op8_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents"))


@query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    held_out = fold() == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held_out)
    return quality.score(docs.withColumn("held_out", held_out), model, out="score").select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op5_extract_html")
def extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


@query("op6_scan_secrets")
def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.array_remove(kinds, a), b)).cast("long").alias(f"n_{secrets.KINDS[3 - a - b]}") for a, b in ((1, 2), (0, 2), (0, 1))]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
                        joined_spans(F.concat("base", "inferred")).alias("spans"))


@query("op7_decontaminate")
def decontaminate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    marked = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))


@query("op10_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    held_out = fold() == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out)
    return toxicity.score(docs.withColumn("held_out", held_out), model, out="score").select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op9_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = neardup.classes(docs).select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "class")
    found = written(found, "near-duplicates")
    named = found.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return found.join(named, "class").select("doc_id", "class_id", "class_size")


@query("op11_source_divergence", source_audit.AUDIT_SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


@query("op12_filter_interaction", filter_audit.AUDIT_SQL)
def filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_byte_pairs")
def byte_pair_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = byte_pairs.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = coder.encode(table(spark, sf_dir, "documents"))
    return coder.decode(encoded).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                                        F.sha2("decoded", 256).alias("decoded_sha256"))
