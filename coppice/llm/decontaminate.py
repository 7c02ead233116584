"""Benchmark decontamination by a prefix-filtered set join.

The set of an item window is its words; a document can only contain the window if it holds the whole set, so it is
enough to join on the prefix of one word, the window's rarest by corpus document frequency. Length and position bounds
drop places where the window cannot lie, and what is left is compared word by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, written
from .words import ascii_lower_words

WINDOW = 10
#: Text of the items that is held in memory at a time; more items are taken in further blocks of this size.
BLOCK_BYTES = 16 << 20


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    width = min(window, len(words))
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def word_frequencies(texts: DataFrame, vocabulary: set[bytes]) -> Counter:
    """In how many rows of the one-column frame each word of the (bounded) vocabulary occurs."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.iloc[:, 0]:
                found.update(shared.value.intersection(ascii_lower_words(text)))
        yield pd.DataFrame({"word": pd.Series([w.decode() for w in found], dtype=object), "n": pd.Series(list(found.values()), dtype="int64")})

    counted = texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({row.word.encode(): row.n for row in counted.collect()})


class WindowIndex:
    """Windows of a block of items by their rarest word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], frequency: Counter, window: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in items:
            for run in item_windows(words, window):
                owners.setdefault(run, set()).add(item)
        self.by_word: dict[bytes, list[tuple[int, list[bytes], list[str]]]] = {}
        for run, ids in owners.items():
            place = min(range(len(run)), key=lambda i: (frequency[run[i]], run[i], i))
            self.by_word.setdefault(run[place], []).append((place, list(run), sorted(ids)))

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans that lie in an occurrence of a window, and the items that occur."""
        by_word = self.by_word
        if by_word.keys().isdisjoint(words):
            return [], set()
        spans, ids, n = [], set(), len(words)
        for at, word in enumerate(words):
            for place, run, owners in by_word.get(word, ()):
                start, end = at - place, at - place + len(run)
                if start >= 0 and end <= n and words[start:end] == run:
                    spans.append((start, end))
                    ids.update(owners)
        merged: list[list[int]] = []
        for start, end in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        return [(s, e) for s, e in merged], ids


def _marker(shared):
    @F.pandas_udf("n_words long, spans array<struct<start:int,end:int>>, items array<string>")
    def mark(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            rows = []
            for text in texts:
                words = ascii_lower_words(text)
                spans, ids = shared.value.matches(words)
                rows.append((len(words), [{"start": s, "end": e} for s, e in spans], sorted(ids)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return mark


def covered(spans: Column) -> Column:
    """Number of positions in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda s, x: F.struct(
        F.greatest(s["end"], x["end"]).alias("end"),
        (s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("n")), lambda s: s["n"])


def mark_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``hits``: struct (n_words, n_hit, spans, items) with word spans inside any item window and the items' ids.

    Null texts and items have no words; a null item id reads as the empty id; items of fewer than ``window`` words
    are one window; items sharing an id count as one. Items are held in memory in blocks of ``block_bytes`` of text,
    each compared with all rows. Without items nothing is hit. A column ``hits`` is replaced, others are kept.
    """
    listed = only(benchmark, item, item_text).toDF("item", "text").select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text")
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    texts = df.select(F.col(text))
    out, parts = df, []
    for block in range(blocks):
        chosen = listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else listed
        items = [(row.item, ascii_lower_words(row.text)) for row in chosen.collect()]
        vocabulary = {w for _, words in items for w in words}
        index = WindowIndex(items, word_frequencies(texts, vocabulary) if vocabulary else Counter(), window)
        shared = df.sparkSession.sparkContext.broadcast(index)
        out = out.withColumn(f"__hits{block}", _marker(shared)(F.col(text)))
        parts.append(f"__hits{block}")
        if block + 1 < blocks:
            out = written(out, "contamination")
    spans = F.array_sort(F.flatten(F.array(*[F.col(p)["spans"] for p in parts])))
    items = F.array_sort(F.flatten(F.array(*[F.col(p)["items"] for p in parts])))
    return out.withColumn("hits", F.struct(F.col(parts[0])["n_words"].alias("n_words"), covered(spans).alias("n_hit"),
                                           spans.alias("spans"), items.alias("items"))).drop(*parts)
