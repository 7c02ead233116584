"""Quality classifier on supervised subword embeddings.

Every word, every form of a word pair and every character n-gram of a word has a hashed embedding; a document is their mean, classified by a
softmax layer, all trained by stochastic gradient descent. Since the mean is linear, a trained model needs one number
per embedding to score, and a text is scored by array operations over its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .labels import sampled_keys
from .words import BASE, UNBASE, chance, logistic_fit, mixed, powers, range_hashes, spans_of

#: Embeddings, their width, n-gram lengths, bound of the training sample, passes, step size, characters per block.
BUCKETS, WIDTH, GRAMS, SAMPLE, EPOCHS, STEP, BLOCK = 1 << 17, 8, (3, 4, 5), 2000, 4, 0.5, 1 << 18
#: Embeddings see a feature's share of the gradient only, so they learn this much faster than the output layer.
EMBEDDING_RATE = 8
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def blocks(text: str) -> Iterator[np.ndarray]:
    """Code points of the text, each word between single zeros, in blocks that end between words."""
    data = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    space = (data < 256) & _SPACE[np.minimum(data, 255)]
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > BLOCK:
            after = np.flatnonzero(space[start + BLOCK :])
            end = start + BLOCK + int(after[0]) if len(after) else end
        piece, gap = data[start:end], space[start:end]
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]  # the first of a run of white space stands for it
        out = np.where(gap, 0, piece)[keep]
        yield np.concatenate(([0], out, [0])).astype(np.uint64)
        start = end


def buckets(points: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of all words, of all word pairs, and of all n-grams of each length that do not cross a word's edge."""
    starts, ends = spans_of(points != 0)
    if not len(starts):
        return
    words = range_hashes(points, starts, ends)
    yield (words % np.uint64(BUCKETS)).astype(np.int64)
    yield (words[1:] == words[:-1]).astype(np.int64)  # word pairs by form: different (0) or the same word twice (1)
    n = len(points)
    running = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((points + np.uint64(1)) * powers(BASE, "up", n)[:n], out=running[1:])
    edges = np.concatenate(([0], np.cumsum(points == 0)))
    down = powers(UNBASE, "down", n + 1)
    for size in GRAMS:
        if n < size:
            continue
        at = np.flatnonzero(edges[size - 1 : n] == edges[1 : n - size + 2])  # no edge strictly inside
        if len(at):
            h = (running[at + size] - running[at]) * down[at] + np.uint64(size)
            yield (mixed(h) % np.uint64(BUCKETS)).astype(np.int64)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets of a text, their counts, and the number of features."""
    found = [b for block in blocks(text or "") for b in buckets(block)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0
    ids, counts = np.unique(np.concatenate(found), return_counts=True)
    return ids, counts.astype(np.float64), int(counts.sum())


class QualityModel:
    """One number per embedding, and the calibration of their mean."""

    def __init__(self, gains: np.ndarray, weights: np.ndarray):
        self.gains, self.weights = gains, weights

    def margin(self, text: str | None) -> float:
        total, n = 0.0, 0
        for block in blocks(text or ""):
            for ids in buckets(block):
                total += float(self.gains[ids].sum(dtype=np.float64))
                n += len(ids)
        return total / n if n else 0.0

    def scores(self, texts) -> np.ndarray:
        return chance(np.array([self.margin(t) for t in texts], dtype=np.float64).reshape(-1, 1), self.weights)


def train(texts: list[str | None], labels: np.ndarray, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over three quarters of the rows; the margin is calibrated on the rest."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-0.5 / WIDTH, 0.5 / WIDTH, (BUCKETS, WIDTH))
    out = np.zeros((2, WIDTH))
    held = np.arange(len(texts)) % 4 == 3
    rows, step = np.flatnonzero(~held), 0
    share = np.bincount(labels[rows], minlength=2) / max(1, len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(rows):
            ids, counts, n = bag(texts[i])
            rate = STEP * (1 - step / (EPOCHS * len(rows)))
            step += 1
            if not n:
                continue
            mean = counts @ table[ids] / n
            z = out @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= 0.5 / max(share[labels[i]], 0.05)  # classes weigh alike
            back = p @ out
            out -= rate * np.outer(p, mean)
            table[ids] -= (EMBEDDING_RATE * rate * counts / n)[:, None] * back
    model = QualityModel((table @ (out[1] - out[0])).astype(np.float32), np.array([1.0, 0.0]))
    tested = np.flatnonzero(held)
    margins = np.array([model.margin(texts[i]) for i in tested]).reshape(-1, 1)
    if len(set(labels[tested])) == 2:
        scale = max(float(np.abs(margins).mean()), 1e-9)
        w = logistic_fit(margins / scale, labels[tested], ridge=1e-2)
        model.weights = np.array([w[0] / scale, w[1]])
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out, text: str = "text", key: str = "doc_id", label: str = "quality",
        sample: int = SAMPLE) -> QualityModel:
    """Train on at most ``sample`` labelled rows that are not ``held_out``, those whose keys hash lowest.

    Rows with a null key or label are not used; without both labels every text scores the larger class.
    """
    rows = sampled_keys(docs.where(~held_out).select(key, text), labels, label, sample, key).select(text, "label").toArrow().to_pandas()
    y = rows["label"].to_numpy(dtype=np.int64)
    if len(set(y)) < 2:
        sure = 4.0 if not len(y) or y[0] else -4.0
        return QualityModel(np.zeros(BUCKETS, dtype=np.float32), np.array([0.0, sure]))
    return train(list(rows[text]), y)


def score(df: DataFrame, model: QualityModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Adds the chance of label 1, 0 to 1, from the whole text; null and empty texts take the model's prior.

    ``out`` replaces a column of that name; others are kept.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(shared.value.scores(texts), dtype="float64")

    name = free_name(df, "scored")
    return df.withColumn(name, scored(F.col(text))).withColumn(out, F.col(name)).drop(name)
