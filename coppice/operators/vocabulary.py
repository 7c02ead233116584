"""A reversible word vocabulary as tables: counted, numbered, and joined for encoding and decoding.

A text is cut into runs of white space and runs of everything else, so its pieces put together are the text. Ids are
dense: the reserved tokens first, then the pieces by falling frequency (ties by text). Subword merges are not learned
here; the public byte-pair vocabularies serve where those are wanted.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import with_position

# The chunk functions travel with the task, so Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = r"([ \t\n\r\f]+|[^ \t\n\r\f]+)"
_PIECES = re.compile(r"[ \t\n\r\f]+|[^ \t\n\r\f]+")
#: Hash chunks of texts; only their size depends on it, some 0.75 MB of text each for 6 GB.
CHUNKS = 8192
RESERVED = ("<pad>", "<unk>", "<eos>")
PAD, UNKNOWN, END = range(3)


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))


def build(texts: DataFrame, text: str = "text", reserved: Sequence[str] = RESERVED, least: int = 1) -> DataFrame:
    """(token, id, n) of every piece that occurs ``least`` times or more, after the ``reserved`` tokens (n is 0).

    A piece that reads like a reserved token is a token of its own: reserved ids are never looked up by text.
    """
    counts = texts.select(F.explode(pieces(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bucket = F.struct((-F.col("n")).alias("n"), F.substring("token", 1, 2).alias("head"))
    placed = with_position(counts, [F.desc("n"), F.col("token")], bucket, name="id")
    numbered = placed.select("token", (F.col("id") + len(reserved)).cast("bigint").alias("id"), "n")
    first = texts.sparkSession.createDataFrame([(t, i, 0) for i, t in enumerate(reserved)], "token string, id bigint, n bigint")
    return first.unionByName(numbered) if reserved else numbered


def _in_chunks(rows: DataFrame) -> DataFrame:
    """Rows in hash chunks of their key: a chunk asks the vocabulary once for what its texts share."""
    return rows.withColumn("__chunk", F.pmod(F.xxhash64("__key"), F.lit(CHUNKS))).repartition("__chunk")


def _merged(keys: list, values: list) -> dict:
    """The values of every key; rows of one key are one, by place and then value, and null when one of them is."""
    found = {}
    for key, value in zip(keys, values, strict=True):
        found.setdefault(key, []).append(value)
    return {key: None if any(v is None for v in many) else many[0] if len(many) == 1 else
            [x for _, x in sorted((at, x) for v in many for at, x in enumerate(v))] for key, many in found.items()}


def _looked_up(rows: DataFrame, codes: DataFrame, key: str, value: str, kind: T.DataType, read: Callable[[dict], Callable]) -> DataFrame:
    """(key, value): every chunk of ``rows`` (__key, value, __chunk) with its own (given, wanted) pairs of ``codes`` (by __of)."""
    schema = T.StructType([T.StructField(key, rows.schema["__key"].dataType), T.StructField(value, kind)])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        convert, given = read(dict(zip(right["given"].to_pylist(), right["wanted"].to_pylist(), strict=True))), left["value"].to_pylist()
        merged = _merged(left["__key"].to_pylist(), [None if v is None else convert(v) for v in given])
        values = [v if v is None or value == "ids" else "".join(v) for v in merged.values()]
        return pa.table({key: pa.array(merged, left["__key"].type), value: pa.array(values, pa.list_(pa.int64()) if value == "ids" else pa.string())})

    return rows.groupBy("__chunk").cogroup(codes.groupBy("__of")).applyInArrow(work, schema)


def encode(texts: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", reserved: int = len(RESERVED), unknown: int = UNKNOWN) -> DataFrame:
    """(key, ids) by a join on the piece; other pieces become ``unknown``, a null text has null ids. ``key`` is unique.

    The distinct pieces of a chunk of texts are joined with the vocabulary, not every occurrence.
    """
    rows = _in_chunks(texts.select(F.col(key).alias("__key"), F.col(text).alias("value")))
    asked = rows.select(F.col("__chunk").alias("__of"), F.explode(pieces(F.col("value"))).alias("given")).distinct()
    codes = asked.join(vocabulary.where(F.col("id") >= reserved).select(F.col("token").alias("given"), F.col("id").alias("wanted")), "given")
    return _looked_up(rows, codes, key, "ids", T.ArrayType(T.LongType()), lambda known: lambda value: [known.get(p, unknown) for p in _PIECES.findall(value)])


def decode(encoded: DataFrame, vocabulary: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, text) by a join on the id; null ids give null. An id that the vocabulary lacks is an error."""
    rows = _in_chunks(encoded.select(F.col(key).alias("__key"), F.col(ids).alias("value")))
    asked = rows.select(F.col("__chunk").alias("__of"), F.explode("value").alias("given")).distinct()
    codes = asked.join(vocabulary.select(F.col("id").alias("given"), F.col("token").alias("wanted")), "given")

    def read(known):
        def tokens(value):
            if not known.keys() >= set(value):
                raise ValueError("an id is not in the vocabulary")
            return [known[i] for i in value]
        return tokens

    return _looked_up(rows, codes, key, "text", T.StringType(), read)
