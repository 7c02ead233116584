"""The corpus pipeline: stages over ``documents``, each working on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import decontaminate, mixing, neardup, sharding, toxicity
from coppice.llm.common import fold, only, table, whole_text, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 40
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic stays below ``TOXIC``."""
    docs = only(docs, *COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold() == 2)
    return toxicity.score(docs, model).where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.keep_one(only(docs, *COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    marked = decontaminate.mark_contamination(only(docs, *COLUMNS), table(spark, sf_dir, "benchmark"))
    return marked.where(F.col("hits.n_hit") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by the calibrated mixing probabilities."""
    topical = only(docs, *COLUMNS).withColumn("topic", mixing.topic_of(whole_text()))
    return mixing.mix(topical, "doc_id", "text", ["source", "lang", "topic"]).where("sampled").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, and the shard it would have were there one more."""
    return sharding.assign_shards(only(docs, *COLUMNS), "doc_id", [1.0] * SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("mixing", mix), ("sharding", shard)]
#: A learned model, near-duplicate classes and an iterated fit have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
