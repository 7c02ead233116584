"""Toxicity by class-conditional Kneser-Ney models.

A word's weight in a class is its number of distinct left neighbours there, not its count, so copies of a text add
nothing. The counts are discounted and interpolated with the counts of both classes together: an expression seen in few
contexts falls back on what the classes share and says nothing. A text is judged by the difference of its toxic and its
ordinary log-likelihood, normalised by length, over the whole and over its most toxic passage, and by the part of it
that words which clearly favour the toxic class hold. Words are told apart by their whole 64-bit hash, and the counts
are a table that grows with the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written
from .labels import sampled_keys, with_label
from .words import logistic_fit, padded_mean_peak, word_hashes

#: Absolute discount; words of a passage; bound of the calibration sample.
DISCOUNT, PASSAGE, CALIBRATION = 3.0, 50, 3000
#: Telling words (12 bytes each) up to which every task gets them all; beyond it texts and words are joined.
SMALL_WORDS = 2_000_000
#: Words of which the pairs are made distinct before they are shuffled.
WORDS_AT_ONCE = 500_000
#: Nats by which a word must favour the toxic class to be clear.
CLEAR = 1.0
N_FEATURES = 5


def context_counts(rows: DataFrame, text: str) -> DataFrame:
    """(word, toxic, ordinary): distinct left neighbours of every word by class, over all ``rows`` (text, label)."""
    def frame(waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        word, left, label = (np.concatenate(c) for c in zip(*waiting, strict=True))
        return pd.DataFrame({"word": word.view(np.int64), "left": left.view(np.int64), "label": label}).drop_duplicates()

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0
        for batch in batches:
            for hashes, label in zip(word_hashes(batch.iloc[:, 0]), batch["label"], strict=True):
                left = np.concatenate((np.zeros(1, dtype=np.uint64), hashes))[: len(hashes)]
                waiting.append((hashes, left, np.full(len(hashes), label, dtype=np.int8)))
                size += len(hashes)
                if size >= WORDS_AT_ONCE:
                    yield frame(waiting)
                    waiting, size = [], 0
        if size:
            yield frame(waiting)

    seen = rows.select(text, "label").mapInPandas(pairs, "word long, left long, label byte").distinct()
    return seen.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary"))


def likelihood_gaps(counts: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(word, gap): log P(word | toxic) - log P(word | ordinary) by interpolated Kneser-Ney, where it is not zero.

    A word that neither class has in more than ``discount`` contexts, and any other word, has the gap zero.
    """
    def kept(seen: str) -> Column:
        return F.greatest(F.col(seen) - F.lit(discount), F.lit(0.0))

    both = F.col("toxic") + F.col("ordinary") + 0.5
    classes = ("toxic", "ordinary")
    total = counts.agg(F.sum(both).alias("both"), *[F.sum(c).alias(c) for c in classes], *[F.sum(kept(c)).alias(f"kept_{c}") for c in classes]).first()
    # the discounted mass; one weight for both classes, so that unseen words favour neither
    backoff = max(1 - total[f"kept_{c}"] / total[c] if total[c] else 1.0 for c in classes)

    def smoothed(seen: str) -> Column:
        return kept(seen) * ((1 - backoff) / max(total[f"kept_{seen}"] or 0.0, 1.0)) + both * (backoff / (total["both"] or 1.0))

    gap = F.log(smoothed("toxic")) - F.log(smoothed("ordinary"))
    return counts.where(F.greatest("toxic", "ordinary") > discount).select("word", gap.cast("float").alias("gap"))


def features(gaps: np.ndarray, passage: int = PASSAGE) -> list[float]:
    """Of a text's gaps in order: the length-normalised difference of the log-likelihoods over the whole and over the
    most toxic passage, the clear words' share of the most toxic passage and their sum, and the length."""
    n = len(gaps)
    if not n:
        return [0.0] * N_FEATURES
    clear = np.maximum(gaps - CLEAR, 0)
    return [float(gaps.sum()) / (n + passage), padded_mean_peak(gaps, passage), padded_mean_peak(clear, passage),
            float(np.sqrt(clear.sum())) / 10, float(np.log1p(n)) / 10]


class GapTable:
    """Gaps by word hash; words that are not listed have the gap zero."""

    def __init__(self, words: np.ndarray, gaps: np.ndarray):
        order = np.argsort(words.view(np.uint64))
        self.words, self.gaps = words.view(np.uint64)[order], gaps[order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.gaps[at], 0.0).astype(np.float64)


def with_features(df: DataFrame, gaps: DataFrame, n_words: int, text: str, out: str, small: int = SMALL_WORDS) -> DataFrame:
    """Adds the features of every whole text as the array ``out``.

    Up to ``small`` words the gaps are sent to every task. Beyond that each distinct word of a text is joined with its
    gap, and every text gets the gaps of its own words; the result is the same.
    """
    if n_words <= small:
        listed = gaps.toArrow()
        shared = df.sparkSession.sparkContext.broadcast(GapTable(listed["word"].to_numpy(), listed["gap"].to_numpy()))

        @F.pandas_udf("array<double>")
        def from_all(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in series:
                yield pd.Series([features(shared.value.of(h)) for h in word_hashes(texts)])

        return df.withColumn(out, from_all(F.col(text)))

    def own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, hashes in zip(batch["name"], word_hashes(batch["body"]), strict=True):
                yield pd.DataFrame({"name": name, "word": np.unique(hashes).view(np.int64)})

    @F.pandas_udf("array<double>")
    def from_own(texts: pd.Series, words: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([features(GapTable(np.asarray([] if w is None else w, dtype=np.int64), np.asarray([] if v is None else v, dtype=np.float32)).of(h))
                          for h, w, v in zip(word_hashes(texts), words, values, strict=True)])

    name = F.xxhash64(F.col(text), F.reverse(text))
    held = df.select(name.alias("name"), F.col(text).alias("body")).mapInPandas(own_words, "name long, word long").distinct()
    found = held.join(gaps, "word").groupBy("name").agg(F.collect_list(F.struct("word", "gap")).alias("own"))
    key, own = free_name(df, "name_of"), free_name(df, "own")
    joined = df.withColumn(key, name).join(found.select(F.col("name").alias(f"_{key}"), F.col("own").alias(own)), F.col(key) == F.col(f"_{key}"), "left")
    return joined.withColumn(out, from_own(F.col(text), F.col(f"{own}.word"), F.col(f"{own}.gap"))).drop(key, f"_{key}", own)


class ToxicityModel:
    """The telling words' gaps (a written table), their number, and the calibration of the features."""

    def __init__(self, gaps: DataFrame, n_words: int, weights: np.ndarray):
        self.gaps, self.n_words, self.weights = gaps, n_words, weights


def fit(docs: DataFrame, labels: DataFrame, held_out, text: str = "text", key: str = "doc_id", label: str = "toxic") -> ToxicityModel:
    """Count contexts in all labelled rows but the ``held_out`` and a calibration quarter, and calibrate on the latter.

    ``held_out`` is a boolean column; a row with a null key or label is not used. Without labels every text scores
    the same small chance.
    """
    open_rows = docs.where(~held_out).select(key, text)
    calibrates = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(4)) == 0
    counted = with_label(open_rows.where(~calibrates), labels, label, key)
    gaps = written(likelihood_gaps(written(context_counts(counted, text), "toxicity-counts")), "toxicity-gaps")
    n_words = gaps.count()
    sample = sampled_keys(open_rows.where(calibrates), labels, label, CALIBRATION, key).select(text, "label")
    sample = with_features(sample, gaps, n_words, text, "features").select("features", "label").toArrow().to_pandas()
    if sample["label"].nunique() < 2:
        return ToxicityModel(gaps, n_words, np.array([0.0, 10.0, 20.0, 40.0, -10.0, -5.0]))
    return ToxicityModel(gaps, n_words, logistic_fit(np.stack(sample["features"]), sample["label"].to_numpy(), ridge=1e-3))


def score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds the chance of being toxic, 0 to 1, from the whole text. Null and empty texts have no words and a low score.

    ``out`` replaces a column of that name; others are kept.
    """
    found = free_name(df, "found")
    judged = with_features(df, model.gaps, model.n_words, text, found)
    *weights, intercept = (float(w) for w in model.weights)
    z = F.lit(intercept)
    for i, weight in enumerate(weights):
        z = z + F.get(found, F.lit(i)) * weight
    return judged.withColumn(out, 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).drop(found)
