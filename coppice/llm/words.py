"""Words of whole texts as 64-bit hashes, computed over arrays of bytes instead of one word at a time.

A word is a run of digits, lower-case letters and characters beyond ASCII of the lower-cased text. Texts are handled
in blocks of about ``BLOCK`` bytes that end between words, so memory does not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

BLOCK = 1 << 20
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TO_ZERO = bytes(b if b in WORD_BYTES else b + 32 if 65 <= b <= 90 else 0 for b in range(256))
_TO_SPACE = _TO_ZERO.replace(b"\0", b" ")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, name: str, length: int) -> np.ndarray:
    """base^0 .. base^(length-1) modulo 2^64, kept between calls."""
    known = _powers.get(name)
    if known is None or len(known) < length:
        steps = np.full(max(length, BLOCK + 1024), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return known


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every pair, by differences of one running polynomial."""
    running = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(BASE, "up", len(values))[: len(values)], out=running[1:])
    return mixed((running[ends] - running[starts]) * powers(UNBASE, "down", len(values) + 1)[starts])


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    padded = np.zeros(len(flags) + 2, dtype=np.int8)
    padded[1:-1] = flags
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[0::2], edges[1::2]


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > BLOCK:
        cut = data.find(b"\0", at + BLOCK)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(data, dtype=np.uint8)
    starts, ends = spans_of(values != 0)
    return range_hashes(values, starts, ends), starts


def word_hashes(texts: Iterable[str | None]) -> list[np.ndarray]:
    """The word hashes of every text in order; null has no words."""
    out: list[np.ndarray] = []
    waiting: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if waiting:
            hashes, starts = _hash_block(b"\0".join(waiting))
            ends = np.cumsum([len(d) + 1 for d in waiting])
            out.extend(np.split(hashes, np.searchsorted(starts, ends[:-1])))
            waiting.clear()
            size = 0

    for text in texts:
        data = (text or "").lower().encode().translate(_TO_ZERO)
        if len(data) > BLOCK:
            flush()
            out.append(np.concatenate([_hash_block(piece)[0] for piece in _pieces(data)]))
            continue
        if size + len(data) > BLOCK:
            flush()
        waiting.append(data)
        size += len(data) + 1
    flush()
    return out


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z only, as UTF-8."""
    return (text or "").encode().translate(_TO_SPACE).split()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text that has words is one shingle."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for j, factor in enumerate(powers(BASE, "up", 64)[1 : width + 1]):
        total += words[j : n - width + 1 + j] * factor
    return mixed(total + np.uint64(width))


def padded_mean_peak(values: np.ndarray, window: int) -> float:
    """Largest mean of ``window`` neighbouring values; a shorter sequence is padded with zeros."""
    if len(values) <= window:
        return float(values.sum()) / window
    running = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return float((running[window:] - running[:-window]).max()) / window


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps for a small logistic regression; the last weight is the intercept."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hessian, design.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
    return w


def chance(x: Sequence[float] | np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.asarray(x, dtype=np.float64) @ w[:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
