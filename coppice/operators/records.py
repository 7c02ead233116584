"""Shaping raw problems and chats into training records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the system turn of every record.
SYSTEM_PROMPT = (
    "A conversation that the assistant solves the user's problem. The assistant first thinks about the reasoning "
    "process in the mind and then provides the user with the answer. The reasoning process and answer are enclosed "
    "within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> all the reasoning process here "
    "</think> <answer> final answer here </answer>."
)
# Fixed value: the data source of the records.
DATA_SOURCE = "igsm"
# The default chat layout and the suffix that opens the reasoning block.
HEADER_OPEN = "<|start_header_id|>"
HEADER_CLOSE = "<|end_header_id|>\n\n"
TURN_END = "<|eot_id|>"
THINK_PREFIX = "<think>"
# Names of a data set's size when none is given, and its seed, by split.
SPLIT_SIZES = {"SFT": 5000, "RL_train": 10000, "RL_val": 500, "test": 500}
SPLIT_SEEDS = {"SFT": 100, "RL_train": 200, "RL_val": 300, "test": 400}


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def shape_rl_record(raw: DataFrame, system_prompt: str = SYSTEM_PROMPT, source: str = DATA_SOURCE,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Raw problem -> prompt of a system and a user turn, rule reward with the answer as text."""
    return raw.select(
        *keep, F.lit(source).alias("data_source"),
        F.array(turn("system", F.lit(system_prompt)), turn("user", F.col("query"))).alias("prompt"),
        F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("final_answer").cast("string").alias("ground_truth"))
        .alias("reward_model"),
        F.struct(F.col("num_ops").cast("int").alias("num_ops"), F.col("response").alias("answer")).alias("extra_info"))


def shape_sft_record(raw: DataFrame, system_prompt: str = SYSTEM_PROMPT, source: str = DATA_SOURCE,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Raw problem -> system, user and assistant turns; the marked answer is null when there is none."""
    marked = F.col("response_with_mask") if "response_with_mask" in raw.columns else F.lit(None)
    return raw.select(
        *keep, F.lit(source).alias("data_source"),
        F.array(turn("system", F.lit(system_prompt)), turn("user", F.col("query")),
                turn("assistant", F.col("response"))).alias("message"),
        F.struct(F.col("num_ops").cast("int").alias("num_ops"), F.col("final_answer").cast("bigint").alias("final_answer"),
                 marked.cast("string").alias("answer_with_mask")).alias("extra_info"))


def collect_turns(turns: DataFrame, keys: Sequence[str], order: str, role: str, content: str,
                  out: str = "chat") -> DataFrame:
    """Turn rows -> one chat per key, turns in order. The chat is one record and must fit a cell."""
    items = F.sort_array(F.collect_list(F.struct(order, F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(*keys).agg(items.alias("__t")).select(
        *keys, F.transform("__t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias(out))


def exchanges(turns: DataFrame, conversation: str, number: str, role: str, content: str, asks: str = "user", answers: str = "assistant") -> DataFrame:
    """(conversation, number, prompt, response): every answer with the question right before it, one row per exchange.

    Turns are paired by their number, so the turns of one long conversation spread over tasks. An answer after anything
    but a question has no row; of repeated turns each question meets each answer.
    """
    asked = turns.where(F.col(role) == asks).select(F.col(conversation), (F.col(number) + 1).alias(number), F.col(content).alias("prompt"))
    said = turns.where(F.col(role) == answers).select(conversation, number, F.col(content).alias("response"))
    return said.join(asked, [conversation, number]).select(conversation, number, "prompt", "response")


def render_chat(chat: Column, generation_prompt: bool = False, suffix: str = "", header_open: str = HEADER_OPEN,
                header_close: str = HEADER_CLOSE, turn_end: str = TURN_END) -> Column:
    """A chat as one string; ``suffix`` is appended last (the reasoning tag of a prompt to be answered)."""
    body = F.array_join(F.transform(chat, lambda m: F.concat(
        F.lit(header_open), m["role"], F.lit(header_close), m["content"], F.lit(turn_end))), "")
    tail = (header_open + "assistant" + header_close if generation_prompt else "") + suffix
    return F.concat(body, F.lit(tail)) if tail else body


def extract_nested_key(df: DataFrame, column: str, path: Sequence[str]) -> Column:
    """Walk ``path`` through structs and maps, unwrapping one-element arrays on the way."""
    out, kind = F.col(column), df.schema[column].dataType
    for key in path:
        while isinstance(kind, T.ArrayType):
            out = F.when(F.size(out) == 1, F.get(out, F.lit(0))).otherwise(
                F.from_json(F.raise_error(F.lit(f"{column}: expected a one-element list before {key}")).cast("string"),
                            kind.elementType) if isinstance(kind.elementType, T.StructType) else F.lit(None))
            kind = kind.elementType
        out = out[key]
        kind = kind[key].dataType if isinstance(kind, T.StructType) else kind.valueType
    return out


def default_index(df: DataFrame, column: str = "extra_info", key: str = "index") -> Column:
    kind = df.schema[column].dataType if column in df.columns else None
    if isinstance(kind, T.StructType) and key in kind.names:
        return F.coalesce(F.col(column)[key].cast("bigint"), F.lit(0).cast("bigint"))
    return F.lit(0).cast("bigint")


def flatten_struct(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested structs to flat columns named by their path."""
    def leaves(kind, path):
        for field in kind.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))
    return df.select(*leaves(df.schema, []))


def params_to_json(df: DataFrame, lists_as_dicts: bool = False) -> Column:
    """A row as JSON; lists optionally as {"list_len": n, "0": ..., "1": ...}."""
    if not lists_as_dicts:
        return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})

    def text(value: Column, kind) -> Column:
        if isinstance(kind, T.StructType):
            fields = [F.concat(F.lit(f'"{f.name}":'), text(value[f.name], f.dataType)) for f in kind.fields]
            return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
        if isinstance(kind, T.ArrayType):
            items = F.transform(value, lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'),
                                                             text(x, kind.elementType)))
            length = F.concat(F.lit('"list_len":'), F.size(value).cast("string"))
            return F.concat(F.lit("{"), F.array_join(F.concat(F.array(length), items), ","), F.lit("}"))
        wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)

    return text(F.struct(*df.columns), df.schema)


def dataset_name(data_type: Column, size: Column, question_aug: Column, answer_aug: Column, use_cot: Column,
                 ops: Column, detailed: Column, reflection_prob: Column, analysis_level: Column) -> Column:
    """Data-set name that encodes split, size, augmentation, operations and answer flags."""
    defaults = F.lit(0)
    for name, n in SPLIT_SIZES.items():
        defaults = F.when(data_type == name, n).otherwise(defaults)
    n = F.when(size > 0, size).otherwise(defaults).cast("bigint")
    size_text = F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("K"))).otherwise(n.cast("string"))
    aug = (F.when(question_aug > 0, F.concat(F.lit("_"), question_aug.cast("string"), F.lit("Qaug")))
           .when(answer_aug > 0, F.concat(F.lit("_"), answer_aug.cast("string"), F.lit("Aaug"))).otherwise(F.lit("")))
    cot = F.concat(data_type, F.lit("_"), size_text, aug, F.lit("_CoT_op_"), ops, F.lit("_"),
                   F.when(detailed, F.lit("detailed")).otherwise(F.lit("no_detailed")), F.lit("_reflect_"),
                   reflection_prob.cast("string"), F.lit("_analysis_"), analysis_level.cast("string"))
    return F.when(use_cot, cot).otherwise(F.concat(data_type, F.lit("_"), size_text, F.lit("_no_CoT_op_"), ops))


def operations_label(force: Column, low: Column, high: Column) -> Column:
    return F.when(force, high.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))


def filter_answer_bound(raw: DataFrame, bound: int = 1000, answer: str = "final_answer") -> DataFrame:
    return raw.where(F.abs(F.col(answer)) < bound)


def downsample_zero_answers(raw: DataFrame, row_id: str, min_operations: int, ratio: float = 0.6, seed: object = 0,
                            answer: str = "final_answer") -> DataFrame:
    """Drop zero-answer rows with probability ``ratio``, only for hard sets (more than 20 operations)."""
    if min_operations <= 20:
        return raw
    return raw.where((F.col(answer) != 0) | (unit_hash(seed, F.col(row_id)) >= ratio))


def unit_hash(seed: object, *parts: Column) -> Column:
    """Reproducible uniform draw in [0, 1) from md5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def zero_answer_ratio(raw: DataFrame, answer: str = "final_answer") -> DataFrame:
    return raw.agg(F.avg((F.col(answer) == 0).cast("double")).alias("zero_ratio"), F.count(F.lit(1)).alias("n"))
