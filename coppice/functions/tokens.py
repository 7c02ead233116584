"""Token-array expressions: one row per sequence, arrays of ids and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 15


def word_tokens(text: Column) -> Column:
    """Whitespace-separated words of a text."""
    return F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: w != "")


def hashed_ids(words: Column, digits: int = HASH_DIGITS) -> Column:
    """Default tokenizer: a word's id is the head of its md5, 60 bits of it, so no vocabulary is joined and distinct words
    of any corpus practically never share an id. Ids are not negative, so -1 can pad and end tokens stay apart."""
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, digits), 16, 10).cast("bigint"))


def tokenize(text: Column) -> Column:
    return hashed_ids(word_tokens(text))


def mask_total(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda s, x: s + x)


def mask_lengths(mask: Column, response_length: Column | int) -> tuple[Column, Column]:
    """Valid prompt and response tokens of a mask whose last ``response_length`` positions are the response."""
    prompt = F.slice(mask, F.lit(1), F.size(mask) - response_length)
    return mask_total(prompt), mask_total(F.slice(mask, -response_length, response_length))


def ones(ids: Column) -> Column:
    return F.transform(ids, lambda _: F.lit(1).cast("bigint"))


def pad_to_length(ids: Column, length: Column | int, pad: int, left: bool = False) -> Column:
    """Pad up to ``length``; arrays that are long enough stay as they are."""
    n = length if isinstance(length, Column) else F.lit(length)
    filler = F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(n - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(filler, ids) if left else F.concat(ids, filler)


def truncate(ids: Column, length: int, side: str) -> Column:
    """Cut to ``length``: ``left`` drops the head, ``right`` drops the tail, ``error`` refuses."""
    if side == "left":
        return F.when(F.size(ids) > length, F.slice(ids, -length, length)).otherwise(ids)
    if side == "right":
        return F.slice(ids, 1, length)
    if side == "error":
        message = F.concat(F.lit("sequence_length="), F.size(ids).cast("string"), F.lit(f" is larger than max_length={length}"))
        return F.when(F.size(ids) <= length, ids).otherwise(
            F.split(F.raise_error(message).cast("string"), ",").cast("array<bigint>"))
    raise NotImplementedError(f"unknown truncation {side!r}")


def pad_and_truncate(ids: Column, mask: Column, length: int, pad: int, left_pad: bool = True,
                     truncation: str = "error") -> tuple[Column, Column]:
    """Ids and mask at exactly ``length``."""
    return (pad_to_length(truncate(ids, length, truncation), length, pad, left_pad),
            pad_to_length(truncate(mask, length, truncation), length, 0, left_pad))


def strip_by_mask(ids: Column, mask: Column) -> Column:
    """Drop left padding: keep as many tail tokens as the mask counts."""
    n = mask_total(mask).cast("int")
    return F.slice(ids, F.size(ids) - n + 1, n)


def strip_by_pad(ids: Column, pad: int) -> Column:
    """Drop everything before the first id that is not the pad id."""
    first = F.array_position(F.transform(ids, lambda x: x != pad), True).cast("int")
    return F.when(first > 0, F.slice(ids, first, F.size(ids))).otherwise(F.slice(ids, 1, 0))


def eos_mask(ids: Column, eos: list[int]) -> Column:
    """1 up to and including the first end token."""
    first = F.array_position(F.transform(ids, lambda x: x.isin(eos)), True)
    return F.transform(ids, lambda _, i: F.when((first == 0) | (i < first), 1).otherwise(0).cast("bigint"))


def sft_example(prompt: Column, response: Column, length: int, pad: int, truncation: str) -> dict[str, Column]:
    """Prompt + response (end token included) at ``length`` with the loss mask of supervised tuning.

    The loss mask is the attention mask with the first prompt_len - 1 positions and the position
    min(prompt_len + response_len, length) - 1 zeroed.
    """
    ids = F.concat(prompt, response)
    padded, mask = pad_and_truncate(ids, ones(ids), length, pad, left_pad=False, truncation=truncation)
    head = F.least(F.size(prompt), F.lit(length)) - 1
    last = F.least(F.size(ids), F.lit(length)) - 1
    loss = F.transform(mask, lambda m, i: F.when((i < head) | (i == last), F.lit(0).cast("bigint")).otherwise(m))
    return {"input_ids": padded, "attention_mask": mask, "position_ids": right_padded_positions(mask), "loss_mask": loss}


def right_padded_positions(mask: Column) -> Column:
    """Position ids of a mask that is a run of ones followed by zeros, without a running sum."""
    n = mask_total(mask)
    return F.transform(mask, lambda _, i: F.greatest(F.least(i.cast("bigint"), n - 1), F.lit(0).cast("bigint")))


def left_padded_positions(mask: Column) -> Column:
    """Position ids of a mask that is zeros followed by a run of ones."""
    shift = F.size(mask) - mask_total(mask)
    return F.transform(mask, lambda _, i: F.greatest(i - shift, F.lit(0).cast("bigint")))


def sft_text_batch(ids: Column, length: int, pad: int) -> dict[str, Column]:
    """Whole chat as text: right pad, cut; the prompt is not masked; labels are the ids shifted by one."""
    padded, mask = pad_and_truncate(ids, ones(ids), length, pad, left_pad=False, truncation="right")
    return {"input_ids": padded, "attention_mask": mask, "loss_mask": F.slice(mask, 1, length - 1),
            "labels": F.slice(padded, 2, length - 1)}


def shown(ids: Column) -> Column:
    """An array as comma-separated text."""
    return F.array_join(ids.cast("array<string>"), ",", "null")


# ---------------------------------------------------------------- content markers
_MARKED = r"(?s)<<(.*?)(>>|\z)"
# The parts of words inside a marker are followed by _FLAG; in the text itself _FLAG and _SAFE are written as _SAFE and a letter.
_FLAG, _SAFE = "\ufdd1", "\ufdd0"


def strip_markers(text: Column) -> Column:
    """Text without its << >> markers; unmatched markers stay, an unclosed one runs to the end."""
    return F.regexp_replace(text, _MARKED, "$1")


def _pieces(text: Column, inside) -> Column:
    """Outside and inside pieces in order, each inside piece passed through ``inside``."""
    outer = F.split(text, _MARKED, -1)
    inner = F.regexp_extract_all(text, F.lit(_MARKED), F.lit(1))
    return outer, F.transform(inner, inside)


def marker_mask(text: Column) -> Column:
    """One character per character of the cleaned text: 1 inside a marker, 0 outside."""
    outer, inner = _pieces(text, lambda p: F.repeat(F.lit("1"), F.length(p)))
    flat = F.zip_with(outer, inner, lambda o, i: F.concat(F.repeat(F.lit("0"), F.length(o)), F.coalesce(i, F.lit(""))))
    return F.array_join(flat, "")


def content_token_mask(text: Column) -> Column:
    """{words, inside}: words of the cleaned text, and whether any character of a word was inside a marker.

    The parts of words inside carry a flag through the split, which keeps the work linear in the text.
    """
    safe = F.replace(F.replace(text, F.lit(_SAFE), F.lit(_SAFE + "s")), F.lit(_FLAG), F.lit(_SAFE + "f"))
    outer, inner = _pieces(safe, lambda p: F.regexp_replace(p, "([^ \\t\\r\\n]+)", "$1" + _FLAG))
    flagged = F.array_join(F.zip_with(outer, inner, lambda o, i: F.concat(o, F.coalesce(i, F.lit("")))), "")
    words = F.filter(F.split(flagged, "[ \\t\\r\\n]+", -1), lambda w: w != "")
    return F.element_at(F.transform(F.array(words), lambda ws: F.struct(
        F.transform(ws, lambda w: F.replace(F.replace(F.replace(w, F.lit(_FLAG), F.lit("")), F.lit(_SAFE + "f"), F.lit(_FLAG)),
                                            F.lit(_SAFE + "s"), F.lit(_SAFE))).alias("words"),
        F.transform(ws, lambda w: F.contains(w, F.lit(_FLAG))).alias("inside"))), 1)
