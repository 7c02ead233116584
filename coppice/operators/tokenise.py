"""Chats and texts to padded, masked, packed token rows (one row per sequence)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from .joins import one_row, with_group_stats
from .ordered import running_total
from .records import render_chat


def filter_prompt_length(df: DataFrame, tokens: Column, max_prompt_length: int) -> DataFrame:
    return df.where(F.size(tokens) <= max_prompt_length)


def flag_overlong(df: DataFrame, tokens: Column, max_prompt_length: int, batch: Sequence[str]) -> DataFrame:
    """Rows stay; batches whose padded length is over the limit are flagged."""
    sized = df.withColumn("__n", F.size(tokens))
    out = with_group_stats(sized, batch, F.max("__n").alias("padded_length"))
    return out.withColumn("overlong", (F.col("padded_length") > max_prompt_length).cast("int")).drop("__n")


def pad_ragged(df: DataFrame, ids: str, pad: int, max_length: int | None = None, batch: Sequence[str] = ()) -> DataFrame:
    """Right-pad to the longest row of the batch, or to ``max_length`` when that is longer."""
    sized = df.withColumn("__n", F.size(ids))
    if batch:
        sized = with_group_stats(sized, batch, F.max("__n").alias("__longest"))
        longest = F.col("__longest")
    else:
        longest = one_row(sized, F.max("__n").alias("n"))["n"]
    target = F.greatest(longest, F.lit(max_length or 0))
    return sized.withColumn(ids, K.pad_to_length(F.col(ids), target, pad)).drop("__n", "__longest")


def left_pad_batch(df: DataFrame, ids: str, pad: int, batch: Sequence[str]) -> DataFrame:
    """Left-pad every row to the longest of its batch, with the mask; other columns are kept."""
    sized = with_group_stats(df.withColumn("__n", F.size(ids)), batch, F.max("__n").alias("__longest"))
    mask = K.pad_to_length(K.ones(F.col(ids)), F.col("__longest"), 0, left=True)
    return (sized.withColumn("attention_mask", mask)
            .withColumn(ids, K.pad_to_length(F.col(ids), F.col("__longest"), pad, left=True)).drop("__n", "__longest"))


def rl_example(df: DataFrame, ids: Column, length: int, pad: int, truncation: str = "error") -> DataFrame:
    """Left-padded prompt ids with mask and position ids."""
    padded, mask = K.pad_and_truncate(ids, K.ones(ids), length, pad, left_pad=True, truncation=truncation)
    return (df.withColumn("input_ids", padded).withColumn("attention_mask", mask)
            .withColumn("position_ids", K.left_padded_positions(F.col("attention_mask"))))


def assemble_rollout(df: DataFrame, prompt_ids: str, prompt_mask: str, response_ids: str, eos: list[int], pad: int,
                     response_length: int, batch: Sequence[str] = ()) -> DataFrame:
    """Prompt and padded response in one row; the mask ends at the first end token of the response.

    Responses are padded to the longest of their ``batch``, or to ``response_length`` when that is longer.
    """
    padded = pad_ragged(df, response_ids, pad, response_length, batch)
    return (padded.withColumn("input_ids", F.concat(prompt_ids, response_ids))
            .withColumn("attention_mask", F.concat(F.col(prompt_mask), K.eos_mask(F.col(response_ids), eos))))


def pack_sequences(df: DataFrame, pos: str, mask: str, batch: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(flat indices of valid tokens, cumulative lengths with a leading 0) of every batch of equal-width masks.

    ``pos`` counts the rows of a batch from 0; without ``batch`` the whole frame is one.
    """
    flat = df.select(*batch, F.col(pos), F.size(mask).alias("__w"), F.posexplode(mask).alias("__t", "__m"))
    indices = flat.where(F.col("__m") == 1).select(*batch, (F.col(pos) * F.col("__w") + F.col("__t")).alias("index"))
    lengths = df.select(*batch, F.col(pos).alias("pos"), K.mask_total(F.col(mask)).alias("seqlen"))
    cumulative = running_total(lengths, F.col("seqlen"), [F.col("pos")], F.floor(F.col("pos") / 65536), keys=batch, name="cu_seqlen")
    start = lengths.where(F.col("pos") == 0).select(*batch, F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("cu_seqlen"))
    return indices, start.unionByName(cumulative.select(*batch, (F.col("pos") + 1).alias("pos"), "cu_seqlen"))


def longest_packed(df: DataFrame, mask: str, batch: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*batch).agg(F.max(K.mask_total(F.col(mask))).alias("max_seqlen"))


def pad_packed(cumulative: DataFrame, max_seqlen: DataFrame, size: int, batch: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Pad the packed tokens of every batch to a multiple of ``size``: the padding counts as one more sequence."""
    ends = cumulative.groupBy(*batch).agg(F.max("cu_seqlen").alias("total"), F.max("pos").alias("last"))
    ends = ends.withColumn("pad", F.pmod(F.lit(size) - F.pmod("total", F.lit(size)), F.lit(size)))
    extra = ends.where("pad > 0").select(*batch, (F.col("last") + 1).alias("pos"), (F.col("total") + F.col("pad")).alias("cu_seqlen"))
    none = F.lit(0).cast("bigint")
    lengths = max_seqlen.select(*batch, "max_seqlen", none.alias("pad_size")).unionByName(
        ends.select(*batch, F.col("pad").alias("max_seqlen"), F.col("pad").alias("pad_size")))
    return cumulative.unionByName(extra), lengths.groupBy(*batch).agg(F.max("max_seqlen").alias("max_seqlen"), F.max("pad_size").alias("pad_size"))


def rescore_chat(df: DataFrame, chat: str, response: str, eos_text: str, length: int, pad: int,
                 tokenize=K.tokenize, **template: str) -> DataFrame:
    """Append the decoded response to its chat, render it for another model, right pad or cut."""
    said = F.struct(F.lit("assistant").alias("role"), F.replace(F.col(response), F.lit(eos_text), F.lit("")).alias("content"))
    text = render_chat(F.concat(F.col(chat), F.array(said)), **template)
    out = df.withColumn("text", text).withColumn("__ids", tokenize(F.col("text")))
    ids, mask = K.pad_and_truncate(F.col("__ids"), K.ones(F.col("__ids")), length, pad, left_pad=False, truncation="right")
    return (out.withColumn("input_ids", ids).withColumn("attention_mask", mask)
            .withColumn("position_ids", K.right_padded_positions(F.col("attention_mask"))).drop("__ids"))


def preference_pairs(pairs: DataFrame, prompt: str, chosen: str, rejected: str, length: int, eos: int | None,
                     tokenize=K.tokenize) -> DataFrame:
    """Token rows of prompt + chosen and prompt + rejected, padded with 0 or cut to ``length``."""
    out = pairs
    for side, answer in (("chosen", chosen), ("rejected", rejected)):
        ids = F.concat(tokenize(F.col(prompt)), tokenize(F.col(answer)))
        if eos is not None:
            ids = F.concat(ids, F.array(F.lit(eos).cast("bigint")))
        out = out.withColumn(f"{side}_ids", ids)
        padded, mask = K.pad_and_truncate(F.col(f"{side}_ids"), K.ones(F.col(f"{side}_ids")), length, 0, left_pad=False,
                                          truncation="right")
        out = out.withColumn(f"{side}_mask", mask).withColumn(f"{side}_ids", padded)
    return out


def best_and_worst(answers: DataFrame, keys: Sequence[str], text: str, score: Column, tie: Column) -> DataFrame:
    """Best and worst answer per key with bounded aggregates (no group is collected)."""
    return answers.groupBy(*keys).agg(F.max_by(text, F.struct(score.alias("s"), (-tie).alias("t"))).alias("chosen"),
                                      F.min_by(text, F.struct(score.alias("s"), tie.alias("t"))).alias("rejected"))


def valid_tokens(df: DataFrame, values: str, mask: str) -> Column:
    """Array values whose mask is set."""
    return F.transform(F.filter(F.arrays_zip(values, mask), lambda z: z[mask] == 1), lambda z: z[values])
