"""Byte-level byte-pair encoding and decoding by recursive queries, one in-memory database per partition.

Encoding: every match of the pattern is a word. A word that is a vocabulary entry is that one token. The others become
token-position rows, one per byte, which a recursive query joins with the merge table (left token, right token, merged
token; the merged token's id is its rank) until no neighbours merge any more. A round contracts each word's
leftmost pair of least rank. In long words further pairs of that rank are contracted in the same round where no merge
of the new token with anything could rank lower, for then they would be next in any case.

Decoding: token-position rows join the vocabulary, and an ordered aggregation puts each row's bytes together.

A partition's texts are handled in pieces of bounded size, whatever the length of a text; words already encoded are
remembered up to ``REMEMBERED``. Null texts and empty texts have no tokens, null token lists decode to null. Repeated rows
are rows. ``encode`` ignores other columns, ``decode`` keeps them.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import free_name, only

# The functions below travel with the task, so Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Matches of a long text at a time, characters of texts at a time, words remembered, bytes a recursion, tokens a decoding query.
MATCHES, CHARACTERS, REMEMBERED, WORD_BYTES, TOKENS = 1_000_000, 4_000_000, 300_000, 1 << 20, 1_000_000
#: Bytes from which a word is long.
LONG_WORD = 64

RECURSION = """
WITH RECURSIVE step(word, pos, token, done) AS (
    SELECT word, pos, token, false FROM starts
    UNION ALL (
{round}
    )
)
SELECT word, token FROM step WHERE done ORDER BY word, pos
"""

CONTRACT = RECURSION.format(round="""
        WITH rows AS (SELECT word, pos, token, lead(token) OVER along AS after, lag(pos) OVER along AS before
                      FROM step WHERE NOT done WINDOW along AS (PARTITION BY word ORDER BY pos)),
        least AS (SELECT word, min(merged::BIGINT << 32 | pos) AS low FROM rows JOIN merges ON token = l AND after = r GROUP BY word)
        SELECT word, pos, CASE WHEN pos = (low & 4294967295) THEN (low >> 32)::INTEGER ELSE token END, low IS NULL
        FROM rows LEFT JOIN least USING (word) WHERE coalesce(before <> (low & 4294967295), true)""")

CONTRACT_LONG = RECURSION.format(round="""
        WITH rows AS (SELECT word, pos, token, lead(token) OVER along AS after, row_number() OVER along AS n
                      FROM step WHERE NOT done WINDOW along AS (PARTITION BY word ORDER BY pos)),
        found AS (SELECT word, n, merged, alone FROM rows JOIN merges ON token = l AND after = r),
        least AS (SELECT word, min(merged) AS merged FROM found GROUP BY word),
        hits AS (SELECT word, n, merged, alone, row_number() OVER (PARTITION BY word ORDER BY n) AS k FROM found JOIN least USING (word, merged)),
        taken AS (SELECT word, n, merged FROM (SELECT *, row_number() OVER (PARTITION BY word, n - k ORDER BY n) AS in_run FROM hits)
                  WHERE k = 1 OR (alone AND in_run % 2 = 1))
        SELECT rows.word, rows.pos, coalesce(here.merged, rows.token), least.word IS NULL
        FROM rows LEFT JOIN least ON least.word = rows.word LEFT JOIN taken here ON here.word = rows.word AND here.n = rows.n
        WHERE NOT EXISTS (SELECT 1 FROM taken WHERE taken.word = rows.word AND taken.n = rows.n - 1)""")

JOIN_BYTES = """
SELECT row, from_hex(list_aggregate(list(hex ORDER BY pos), 'string_agg', '')) AS bytes FROM tokens JOIN vocabulary USING (token) GROUP BY row ORDER BY row
"""


def merge_table(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """All pairs of tokens that make a token: l, r, merged, and alone: no merge of the new token ranks lower than itself."""
    pairs = [(ranks[b[:i]], ranks[b[i:]], m) for b, m in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
    l, r, merged = (np.array(c, dtype=np.int32) for c in zip(*pairs, strict=True))  # noqa: E741
    lower = np.union1d(l[merged < l], r[merged < r])
    return {"l": l, "r": r, "merged": merged, "alone": ~np.isin(merged, lower)}


class Words(dict):
    """Numbers of words by order of first sight; ``fresh`` are those not encoded yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """Token ids of texts, with the words met so far."""

    def __init__(self, ranks: dict[bytes, int], merges: dict[str, np.ndarray], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.base = database(merges=pa.table(merges))
        self.byte_tokens = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.words, self.tokens, self.starts, self.sizes = Words(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words one after the other, and how many each has, by the recursive query."""
        lengths = np.array([len(w) for w in words])
        values = self.byte_tokens[np.frombuffer(b"".join(words), dtype=np.uint8)]
        if (values < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        ends = np.cumsum(lengths)
        starts = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
                           "pos": (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32), "token": values})
        self.base.register("starts", starts)
        found = self.base.sql(CONTRACT if lengths.max() < LONG_WORD else CONTRACT_LONG).fetchnumpy()
        self.base.unregister("starts")
        return np.asarray(found["token"], dtype=np.int32), np.bincount(np.asarray(found["word"]), minlength=len(words))

    def learn(self) -> None:
        """Encodes the fresh words, a bounded number of bytes at a time."""
        fresh = [w.encode() for w in self.words.fresh]
        self.words.fresh.clear()
        whole = np.array([self.ranks.get(w, -1) for w in fresh], dtype=np.int32)
        lengths = np.array([len(w) for w in fresh])
        sizes, parts = np.ones(len(fresh), dtype=np.int64), []
        for some in (np.flatnonzero((whole < 0) & (lengths < LONG_WORD)), np.flatnonzero((whole < 0) & (lengths >= LONG_WORD))):
            slices = np.cumsum(lengths[some]) // WORD_BYTES
            for at in np.split(some, np.flatnonzero(np.diff(slices)) + 1) if len(some) else []:
                tokens, sizes[at] = self.contracted([fresh[i] for i in at])
                parts.append((at, tokens))
        ends = np.cumsum(sizes)
        starts, flat = ends - sizes, np.zeros(ends[-1], dtype=np.int32)
        flat[starts[whole >= 0]] = whole[whole >= 0]
        for at, tokens in parts:
            flat[ramps(starts[at], sizes[at])] = tokens
        self.starts = np.concatenate([self.starts, len(self.tokens) + starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.tokens = np.concatenate([self.tokens, flat])

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the numbered words one after the other, and each word's end among them."""
        if self.words.fresh:
            self.learn()
        sizes = self.sizes[numbers]
        tokens, ends = self.tokens[ramps(self.starts[numbers], sizes)], np.cumsum(sizes)
        if len(self.words) > REMEMBERED:
            self.forget()
        return tokens, ends

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))

    def long_text(self, text: str) -> np.ndarray:
        matches, tokens = (m.group() for m in self.pattern.finditer(text)), []
        while words := list(islice(matches, MATCHES)):
            tokens.append(self.gathered(self.numbers(words))[0])
        return np.concatenate(tokens) if tokens else np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> Iterator[list[np.ndarray]]:
        """Token ids of the texts in order, some texts at a time."""
        waiting: list[np.ndarray] = []
        size = 0

        def flushed() -> list[np.ndarray]:
            tokens, ends = self.gathered(np.concatenate(waiting))
            last = np.cumsum([len(w) for w in waiting])
            return np.split(tokens, np.concatenate([[0], ends])[last][:-1])

        for text in texts:
            if waiting and size + len(text or "") > CHARACTERS:
                yield flushed()
                waiting, size = [], 0
            if len(text or "") > CHARACTERS:
                yield [self.long_text(text)]
                continue
            waiting.append(self.numbers(self.pattern.findall(text or "")))
            size += len(text or "")
        if waiting:
            yield flushed()


def ramps(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every start, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def database(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    """An in-memory database of this process with the given tables; it writes no files."""
    base = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "800MB"})
    for name, rows in tables.items():
        base.register("given", rows)
        base.sql(f"CREATE TABLE {name} AS SELECT * FROM given")
        base.unregister("given")
    return base


def list_column(lists: list[np.ndarray]) -> pa.Array:
    """An Arrow list<int> column."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]), pa.int32()))


def joined_bytes(base: duckdb.DuckDBPyConnection, lists: pa.Array, known: np.ndarray) -> Iterator[list[bytes | None]]:
    """The bytes of every token list in order, a bounded number of tokens at a time."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    missing = np.asarray(lists.is_null())
    ends = np.cumsum(sizes)
    tokens = np.asarray(lists.flatten(), dtype=np.int64)
    if len(tokens) and not (0 <= tokens.min() and tokens.max() < len(known) and known[tokens].all()):
        raise ValueError("a token is not in the vocabulary")
    first = 0
    while first < len(sizes):
        done = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, done + TOKENS, side="right")))
        each = sizes[first:last]
        rows = pa.table({"row": np.repeat(np.arange(last - first, dtype=np.int32), each),
                         "pos": np.arange(each.sum(), dtype=np.int32), "token": tokens[done : ends[last - 1]].astype(np.int32)})
        base.register("tokens", rows)
        found = base.sql(JOIN_BYTES).fetchall()
        base.unregister("tokens")
        out: list[bytes | None] = [None if m else b"" for m in missing[first:last]]
        for row, data in found:
            out[row] = data
        yield out
        first = last


class Coder:
    """A vocabulary file of lines "base64 token, rank" with the pattern that cuts texts into words."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern = pattern

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, ids) of every row."""
        rows = only(docs, key, text)
        context = docs.sparkSession.sparkContext
        ranks, merges, pattern = context.broadcast(self.ranks), context.broadcast(merge_table(self.ranks)), self.pattern

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = None
            for batch in batches:
                encoder = encoder or Encoder(ranks.value, merges.value, pattern)
                at = 0
                for ids in encoder.encode(batch.column(1).to_pylist()):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), list_column(ids)], names=[key, "ids"])
                    at += len(ids)

        shape = StructType([rows.schema[0]]).add("ids", ArrayType(IntegerType()))
        return rows.mapInArrow(encoded, shape)

    def decode(self, frame: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """``frame`` with the bytes of its token lists as column ``out`` (with underscores in front if that is taken)."""
        out = free_name(frame, out)
        ranks, place = frame.sparkSession.sparkContext.broadcast(self.ranks), frame.columns.index(ids)

        def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, known = None, np.zeros(max(ranks.value.values(), default=-1) + 1, dtype=bool)
            known[list(ranks.value.values())] = True
            for batch in batches:
                base = base or database(vocabulary=pa.table({"token": pa.array(ranks.value.values(), pa.int32()), "hex": [b.hex() for b in ranks.value]}))
                at = 0
                for data in joined_bytes(base, batch.column(place), known):
                    rows = batch.slice(at, len(data))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, out])
                    at += len(data)

        return frame.mapInArrow(decoded, StructType([*frame.schema.fields]).add(out, BinaryType()))
