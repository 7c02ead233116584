"""Shared inputs: rollout tokens from ``events``, exchanges of ``conversations``, token lengths of ``documents``.

Rollouts: group = user, sequence = user and day, position = rank in time, reward = value, mask = not an error event.
Exchanges: every assistant turn with the user turn before it, as word ids, in training batches of ``BATCH`` exchanges.
Lengths: the words of a document, its first line as the prompt and the rest as the response.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..operators import records
from ..operators.joins import with_group_stats
from ..operators.ordered import id_bucket, time_bucket, with_position
from .common import table

WORDS = "[w for w in regexp_split_to_array({}, '[ \\t\\r\\n]+') if w <> '']"
IDS = "[('0x' || substr(md5(w), 1, 15))::BIGINT for w in regexp_split_to_array({}, '[ \\t\\r\\n]+') if w <> '']"
BATCH = 32

LENGTHS_SQL = f"""SELECT doc_id, source, len({WORDS.format("split_part(text, chr(10), 1)")}) AS p,
  len({WORDS.format('text')}) - len({WORDS.format("split_part(text, chr(10), 1)")}) AS r FROM documents"""

EXCHANGES_SQL = f"""x AS (SELECT a.conv_id * 100 + a.turn AS row_id, {IDS.format('u.text')} AS p, list_append({IDS.format('a.text')}, -2) AS r,
  row_number() OVER (ORDER BY a.conv_id, a.turn) - 1 AS place
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
e AS (SELECT row_id, place // {BATCH} AS batch_id, place % {BATCH} AS pos, p, r, len(p) AS np, len(r) AS nr,
  max(len(p)) OVER (PARTITION BY place // {BATCH}) AS top_p, max(len(r)) OVER (PARTITION BY place // {BATCH}) AS top_r FROM x)"""

TOKENS_SQL = """SELECT user_id AS uid, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS sample, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t,
  CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS mask, value AS score,
  CAST(event_id % 7 AS DOUBLE) AS val, -CAST(event_id % 97 AS DOUBLE) / 50 AS old_lp,
  -CAST(event_id % 89 AS DOUBLE) / 50 AS ref_lp, -CAST(event_id % 101 AS DOUBLE) / 50 AS lp
  FROM events"""


def rollout_tokens(spark, sf_dir, positions: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    e = F.col("event_id")
    tokens = events.select(
        F.col("user_id").alias("uid"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("sample"), e, "ts",
        F.when(F.col("event_type") != "error", 1).otherwise(0).alias("mask"), F.col("value").alias("score"),
        (e % 7).cast("double").alias("val"), (-(e % 97).cast("double") / 50).alias("old_lp"),
        (-(e % 89).cast("double") / 50).alias("ref_lp"), (-(e % 101).cast("double") / 50).alias("lp"))
    if positions:
        tokens = with_position(tokens, [F.col("ts")], time_bucket(F.col("ts")), keys=["uid"], name="t")
    return tokens.drop("ts")


def longest_sequence(spark, sf_dir) -> int:
    """Rows of the largest user: one small aggregate that bounds the scan depth."""
    sizes = table(spark, sf_dir, "events").groupBy("user_id").count()
    return sizes.agg(F.max("count")).first()[0] or 0


def document_lengths(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first, whole = F.size(K.word_tokens(F.substring_index("text", "\n", 1))), F.size(K.word_tokens(F.col("text")))
    return docs.select("doc_id", "source", first.cast("bigint").alias("p"), (whole - first).cast("bigint").alias("r"))


def exchanges(spark, sf_dir) -> DataFrame:
    """(row_id, p, r): word ids of question and answer, the answer with its end token -2."""
    pairs = records.exchanges(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return pairs.select((F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), K.tokenize(F.col("prompt")).alias("p"),
                        F.concat(K.tokenize(F.col("response")), F.array(F.lit(-2).cast("bigint"))).alias("r"))


def in_batches(rows: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds ``batch_id`` and the position ``pos`` inside it, in the order of ``row_id``."""
    placed = with_position(rows, [F.col("row_id")], id_bucket(F.col("row_id")), name="place")
    return placed.select(*rows.columns, F.floor(F.col("place") / size).alias("batch_id"), (F.col("place") % size).alias("pos"))


def mask_rows(spark, sf_dir) -> DataFrame:
    """Attention masks of a batch: prompts left-padded and responses right-padded to its longest ones."""
    sizes = exchanges(spark, sf_dir).select("row_id", F.size("p").alias("np"), F.size("r").alias("nr"))
    rows = with_group_stats(in_batches(sizes), ["batch_id"], F.max("np").alias("top_p"), F.max("nr").alias("top_r"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    mask = F.concat(F.array_repeat(zero, F.col("top_p") - F.col("np")), F.array_repeat(one, F.col("np") + F.col("nr")),
                    F.array_repeat(zero, F.col("top_r") - F.col("nr")))
    return rows.select("row_id", "batch_id", "pos", "top_r", mask.alias("attention_mask"))
