"""Near-duplicate documents by improved consistent weighted sampling of TF-IDF shingles.

1. Document frequencies of word shingles are counted over all documents in a hash table of fixed size. Texts with the
   same words are one node.
2. Each node gets ``SAMPLES`` consistent weighted samples; ``ROWS`` of them make a band.
3. In every band bucket the members are candidates of its smallest member only. A node's most frequent such candidate
   is verified by weighted Jaccard similarity on the whole shingle sets; the links are merged to components.
4. Where a bucket still holds several components, its members are compared with ``MET`` of its members, other ones each
   turn, until ``IDLE_TURNS`` turns in a row link few or few pairs are left. That only spares pairs: whatever is then left in different
   components of a bucket, of any size, is compared in full. Pairs are never made inside a component, nor where the
   bound of ``similar_enough`` excludes a link: shingles that no other open text has cannot be shared.

A pair is a link if its weighted or its plain Jaccard similarity reaches the threshold: in a group of thousands of near
copies all that is shared is frequent, so its weight alone would understate how alike they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, only, written
from .words import mixed, range_hashes, shingles, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Samples, samples a band; frequency table; table of the samples' random variables; shingles sampled at a time.
SAMPLES, ROWS, BUCKETS, DRAWS, CHUNK = 42, 3, 1 << 20, 1 << 14, 4096
BANDS = SAMPLES // ROWS
#: Narrow rows that are sent to every task rather than shuffled against whole texts.
SMALL_SIDE = 4_000_000
#: Members of a block; larger buckets are compared block against block.
BLOCK = 1024
#: Turns in a row that link few of the open members (less than one in ``WEAK``) after which the rest is compared in full, and
#: pairs a member up to which it is at once; members of its bucket that a member meets a turn. They only decide in which
#: order pairs are met.
IDLE_TURNS, WEAK, FEW_PAIRS, MET = 2, 100, 32, 4
#: Bytes of an Arrow batch that are turned into Python objects at a time (one row at least).
PIECE_BYTES = 2 << 20
#: Rows of an Arrow batch, for its buffers outside the heap. Texts and shingle sets may be long.
BATCH_ROWS = 512


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows for what runs inside; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of the batches, about ``PIECE_BYTES`` at a time, so that memory does not grow with a batch's rows."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            if part.num_rows > 1 and part.nbytes > 4 * PIECE_BYTES:  # long rows close together
                for row in range(part.num_rows):
                    yield part.slice(row, 1).to_pandas()
            else:
                yield part.to_pandas()


def arrow(frame: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, preserve_index=False)


def distinct_shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(words, SHINGLE), return_counts=True)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Documents per shingle bucket over all rows of the one-column frame: ``BUCKETS`` numbers, whatever the input.

    Two shingles of one bucket share its count, so a frequency is high by the bucket's mean load, a fixed share of
    all shingles; only shingles well above that share are told apart from rare ones.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, dtype=np.int64)
        for batch in pieces(batches):
            for words in word_hashes(batch.iloc[:, 0]):
                found, _ = distinct_shingles(words)
                table += np.bincount((found % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) if len(found) > BUCKETS // 64 else 0
                if len(found) <= BUCKETS // 64:
                    np.add.at(table, (found % np.uint64(BUCKETS)).astype(np.int64), 1)
        used = np.flatnonzero(table)
        for start in range(0, len(used), 1 << 16):
            part = used[start : start + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(part.astype(np.int32)), "n": pa.array(table[part])})

    counted = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    table = np.zeros(BUCKETS, dtype=np.int64)
    table[counted["bucket"]] = counted["n"]
    return table


def idf_weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Square root of the inverse document frequency, so that a large group of copies still weighs."""
    return np.sqrt(np.log1p(documents / np.maximum(frequencies, 1))).astype(np.float32)


def random_tables(seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and c of Gamma(2, 1) and beta of U(0, 1) for the sampling, by table position."""
    rng = np.random.default_rng(seed)
    r = rng.gamma(2, 1, DRAWS).astype(np.float32)
    c = rng.gamma(2, 1, DRAWS)
    return r, (np.log(c) - r).astype(np.float32), rng.random(DRAWS).astype(np.float32)


class Sampler:
    """Consistent weighted samples of a shingle multiset (4 bytes a bucket are shared with every task)."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        self.r, self.shift, self.beta = random_tables()
        self.steps = (np.random.default_rng(5).integers(1, 1 << 62, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def weights(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Frequency in the text counts by its logarithm, so that one repeated phrase does not outweigh a text."""
        return self.idf[(found % np.uint64(BUCKETS)).astype(np.int64)] * (1 + np.log(counts)).astype(np.float32)

    def samples(self, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """``SAMPLES`` 32-bit names of the chosen (shingle, level); equal for two sets as often as they are similar."""
        best = np.full(SAMPLES, np.inf, dtype=np.float32)
        names = np.zeros(SAMPLES, dtype=np.uint64)
        logs = np.log(weights).astype(np.float32)
        columns = np.arange(SAMPLES)
        for start in range(0, len(found), CHUNK):
            piece = found[start : start + CHUNK]
            at = ((piece[:, None] * self.steps) >> np.uint64(50)).astype(np.int32)
            r, beta = self.r[at], self.beta[at]
            level = np.floor(logs[start : start + CHUNK, None] / r + beta)
            value = self.shift[at] - r * (level - beta)
            first = value.argmin(axis=0)
            low = value[first, columns]
            name = mixed(piece[first] ^ (level[first, columns].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            better = low < best
            best[better], names[better] = low[better], name[better]
        return (names & np.uint64(0xFFFFFFFF)).astype(np.int64)


def with_row_name(docs: DataFrame, key: str, text: str, rid: str = "rid") -> DataFrame:
    """Adds ``rid``, a 64-bit name of key and text; only rows equal in both share it."""
    return docs.withColumn(rid, F.xxhash64(F.col(key).cast("string"), F.col(text), F.isnull(F.col(key)), F.isnull(F.col(text))))


def signatures(rows: DataFrame, sampler) -> DataFrame:
    """(rid, id, same, n, w, bands) of every row of (rid, id, text).

    ``same`` names the word sequence (of a text without words, the text; null for null); ``n`` and ``w`` are the number
    and weight of its shingles. A text without words has no bands.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
        for batch in pieces(batches):
            out = []
            for text, words in zip(batch["text"], word_hashes(batch["text"]), strict=True):
                if not len(words):
                    points = np.frombuffer((text or "").encode(), dtype=np.uint8)
                    name = range_hashes(points, np.array([0]), np.array([len(points)]))[0] if text is not None else None
                    out.append((None if name is None else int(name.astype(np.int64)), 0, 0.0, []))
                    continue
                found, counts = distinct_shingles(words)
                weights = sampler.value.weights(found, counts)
                drawn = sampler.value.samples(found, weights).astype(np.uint64).reshape(BANDS, ROWS)
                bands = mixed((drawn * factors).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                name = range_hashes(words, np.array([0]), np.array([len(words)]))[0]
                out.append((int(name.astype(np.int64)), len(found), float(weights.sum(dtype=np.float64)), bands.astype(np.int64)))
            same, n, w, bands = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"rid": pa.array(batch["rid"], pa.int64()), "id": pa.array(batch["id"], pa.string(), from_pandas=True), "same": pa.array(same, pa.int64()),
                                              "n": pa.array(n, pa.int64()), "w": pa.array(w, pa.float64()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return rows.mapInArrow(sign, "rid long, id string, same long, n long, w double, bands array<long>")


def verified(pairs: DataFrame, sets: DataFrame, sampler, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted or plain Jaccard similarity over whole shingle sets reaches ``threshold``."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = []
            for one, two, m, n in zip(batch["sa"], batch["sb"], batch["ca"], batch["cb"], strict=True):
                x, y = np.asarray(one).view(np.uint64), np.asarray(two).view(np.uint64)
                both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                p, q = np.asarray(m), np.asarray(n)
                share = sampler.value.weights(both, np.minimum(p[i], q[j])).sum(dtype=np.float64)
                all_of = sampler.value.weights(x, p).sum(dtype=np.float64) + sampler.value.weights(y, q).sum(dtype=np.float64)
                plain = len(both) >= threshold * (len(x) + len(y) - len(both))
                keep.append(plain or share >= threshold * (all_of - share) * (1 - 1e-6))
            yield arrow(batch.loc[np.array(keep, dtype=bool), ["a", "b"]])

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    pairs = written(pairs, "dup-pairs")
    wanted = right.join(small(pairs.select("b").distinct()), "b", "left_semi")
    return left.join(small(pairs), "a").join(wanted, "b").select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(compare, "a long, b long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles, counts): the whole sorted shingle set of every row of (id, text)."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [distinct_shingles(words) for words in word_hashes(batch["text"])]
            yield pa.RecordBatch.from_pydict({"id": pa.array(batch["id"], pa.int64()), "shingles": pa.array([f.view(np.int64) for f, _ in found], pa.list_(pa.int64())),
                                              "counts": pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))})

    return docs.mapInArrow(collect, "id long, shingles array<long>, counts array<int>")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id of every linked node's component, by hooking to smaller neighbours and pointer jumps."""
    edges = written(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "dup-edges")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "id"), "dup-labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        onward = labels.select(F.col("id").alias("of"), F.col("label").alias("further"))
        jumped = hooked.join(onward, F.col("label") == F.col("of"), "left").select("id", "old", F.least("label", "further").alias("label"))
        new = written(jumped, "dup-labels")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def small(df: DataFrame) -> DataFrame:
    """``df`` (narrow rows) with a hint to send it to every task if it has at most ``SMALL_SIDE`` rows."""
    return F.broadcast(df) if df.count() <= SMALL_SIDE else df


def comparable(a: str, b: str, threshold: float) -> Column:
    """Length bound: similar sets have numbers or weights of shingles at most the threshold apart."""
    def near(x: Column, y: Column) -> Column:
        return F.least(x, y) >= F.greatest(x, y) * (threshold * (1 - 1e-6))
    return near(F.col(f"{a}n"), F.col(f"{b}n")) | near(F.col(f"{a}w"), F.col(f"{b}w"))


def link_buckets(crowded: DataFrame, sets: DataFrame, sampler, threshold: float) -> DataFrame:
    """(id, label) of all linked nodes of (band, id, n, w)."""
    heads = crowded.groupBy("band").agg(F.min(F.struct("id", "n", "w")).alias("h")).select("band", F.col("h.id").alias("hid"), F.col("h.n").alias("hn"), F.col("h.w").alias("hw"))
    own = crowded.select("band", F.col("id").alias("mid"), F.col("n").alias("mn"), F.col("w").alias("mw"))
    stars = own.join(heads, "band").where((F.col("mid") != F.col("hid")) & comparable("m", "h", threshold))
    shared = stars.groupBy("mid", "hid").agg(F.count(F.lit(1)).alias("bands"))
    best = shared.groupBy("mid").agg(F.min(F.struct((-F.col("bands")).alias("b"), F.col("hid"))).alias("m"))
    links = written(verified(best.select(F.col("mid").alias("a"), F.col("m.hid").alias("b")), sets, sampler, threshold), "dup-links")
    labels = components(links)
    members = open_members(split_bands(crowded, labels).drop("label"), sets, sampler, threshold)
    split, turn, idle = split_bands(members, labels), 0, 0
    while idle < IDLE_TURNS and many_pairs(split):
        found = written(verified(turn_pairs(split, turn, threshold), sets, sampler, threshold), "dup-links")
        turn += 1
        new = found.count()
        idle = idle + 1 if new * WEAK < split.count() else 0
        if new:
            labels = merged(labels, found)
            split = split_bands(members, labels)
    return merged(labels, written(verified(all_pairs(split, threshold), sets, sampler, threshold), "dup-links"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after new links: components of the linked labels only, each relabelled by its smallest."""
    if links.isEmpty():
        return labels
    one, two = labels.toDF("a", "la"), labels.toDF("b", "lb")
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    new = components(between).toDF("old", "new")
    new = small(new)
    renamed = labels.join(new, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))
    first = new.join(labels.select("id"), F.col("old") == F.col("id"), "left_anti").select(F.col("old").alias("id"), F.col("new").alias("label"))
    return written(renamed.unionByName(first), "dup-labels")


def many_pairs(split: DataFrame) -> bool:
    """Would comparing all open members of a bucket in different components make more than ``FEW_PAIRS`` pairs a member?"""
    sizes = split.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    total = sizes.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
    return (total["pairs"] or 0) > FEW_PAIRS * (total["n"] or 0)


def split_bands(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` and their ``label``, of the buckets whose members are in several components."""
    placed = written(members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "dup-placed")
    still = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    return written(placed.join(still, "band"), "dup-split")


def open_members(split: DataFrame, sets: DataFrame, sampler, threshold: float) -> DataFrame:
    """Adds ``fn`` and ``fw``, number and weight of the shingles that another text of ``split`` has too.

    A text of which less than ``threshold`` is shared by both measures has no link and is left out.
    """
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = np.concatenate([np.asarray(x) for x in part["shingles"]])
            weights = sampler.value.weights(found.view(np.uint64), np.concatenate([np.asarray(x) for x in part["counts"]]))
            yield arrow(pd.DataFrame({"shingle": found, "of": np.repeat(part["id"].to_numpy(), [len(x) for x in part["shingles"]]), "weight": weights}))

    nodes = written(split.select("id").distinct(), "dup-open")
    held = sets.join(small(nodes), "id", "left_semi").mapInArrow(exploded, "shingle long, of long, weight float")
    lone = (held.groupBy("shingle").agg(F.min("of").alias("of"), F.max("of").alias("last"), F.min("weight").alias("weight")).where("of = last")
            .groupBy("of").agg(F.count(F.lit(1)).alias("un"), F.sum(F.col("weight").cast("double")).alias("uw")))
    bounded = split.join(lone, F.col("id") == F.col("of"), "left").select(
        "band", "id", "n", "w", (F.col("n") - F.coalesce("un", F.lit(0))).alias("fn"), (F.col("w") - F.coalesce("uw", F.lit(0.0))).alias("fw"))
    least = threshold * (1 - 1e-5)
    return written(bounded.where((F.col("fn") >= F.col("n") * least) | (F.col("fw") >= F.col("w") * least)), "dup-bounded")


def similar_enough(a: str, b: str, threshold: float) -> Column:
    """Upper bound of both similarities: two texts share no more than either of them shares with any open text."""
    def reached(shared_x: Column, shared_y: Column, x: Column, y: Column) -> Column:
        return F.least(shared_x, shared_y) >= (x + y) * (threshold / (1 + threshold) * (1 - 1e-5))
    return (reached(F.col(f"{a}fn"), F.col(f"{b}fn"), F.col(f"{a}n"), F.col(f"{b}n"))
            | reached(F.col(f"{a}fw"), F.col(f"{b}fw"), F.col(f"{a}w"), F.col(f"{b}w")))


def rivals_of(members: DataFrame, others: DataFrame, keys: list[str], threshold: float, also: Column | None = None) -> DataFrame:
    """(a, b) with a > b: members and ``others`` of equal ``keys``, in different components and not excluded by the bound."""
    left = members.select(*[F.col(c).alias(f"m{c}") for c in members.columns])
    right = others.select(*[F.col(c).alias(f"o{c}") for c in others.columns])
    on = (F.col("mlabel") != F.col("olabel")) & similar_enough("m", "o", threshold)
    for key in keys:
        on = on & (F.col(f"m{key}") == F.col(f"o{key}"))
    joined = left.join(right, on if also is None else on & also)
    return joined.select(F.greatest("mid", "oid").alias("a"), F.least("mid", "oid").alias("b")).distinct()


def turn_pairs(split: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Every member against ``MET`` members of its bucket, other ones each turn: as many pairs a member at most."""
    drawn = [F.min(F.struct(F.xxhash64("id", "band", F.lit(turn * MET + i)).alias("r"), "id", "n", "w", "fn", "fw", "label")) for i in range(MET)]
    chosen = split.groupBy("band").agg(F.array_distinct(F.transform(F.array(*drawn), lambda h: h.dropFields("r"))).alias("hs")).select("band", F.explode("hs").alias("h"))
    return rivals_of(split, chosen.select("band", "h.id", "h.n", "h.w", "h.fn", "h.fw", "h.label"), ["band"], threshold)


def all_pairs(split: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a bucket in different components; a bucket above ``BLOCK`` members is cut into cells of two blocks.

    A pair that meets in several buckets is made in the first of them only; a member has at most ``BANDS`` buckets.
    """
    bands = split.groupBy("id").agg(F.collect_set("band").alias("bands")).withColumnRenamed("id", "of")
    blocks = split.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = split.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.join(bands, F.col("id") == F.col("of")).drop("of")
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = spread.select("band", "bands", "id", "n", "w", "fn", "fw", "label", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    once = (F.col("mid") > F.col("oid")) & ((F.col("mlow") == F.col("mhigh")) | (F.col("mblock") != F.col("oblock")))
    first = F.array_min(F.array_intersect("mbands", "obands")) == F.col("mband")
    return rivals_of(cells, cells, ["band", "low", "high"], threshold, once & first)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(rid, id, class) per row: rows of one class are equal in words or linked by similarity ``threshold`` or more.

    A null text is a class of its own row name; texts without words are alike if equal, so all empty texts are one
    class. Repeated rows share a class. Other columns are ignored; an empty table gives no rows.
    """
    rows = with_row_name(only(docs, key, text).toDF("id", "text"), "id", "text").select("rid", F.col("id").cast("string").alias("id"), "text")
    with short_batches(docs.sparkSession):
        idf = idf_weights(document_frequencies(rows.select("text")), rows.count())
        sampler = docs.sparkSession.sparkContext.broadcast(Sampler(idf))
        signed = written(signatures(rows, sampler), "dup-signatures")
        banded = signed.select(F.col("same").alias("id"), "n", "w", F.explode("bands").alias("band"))
        shared = banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("band")
        crowded = written(banded.join(shared, "band").select("band", "id", "n", "w").distinct(), "dup-crowded")
        chosen = signed.join(crowded.select(F.col("id").alias("of")).distinct(), F.col("same") == F.col("of"), "left_semi").groupBy("same").agg(F.min("rid").alias("one"))
        chosen = written(chosen, "dup-chosen")
        texts = rows.join(small(chosen), F.col("rid") == F.col("one")).select(F.col("same").alias("id"), "text")
        sets = written(shingle_sets(texts.dropDuplicates(["id"])), "dup-sets")
        labels = link_buckets(crowded, sets, sampler, threshold)
    placed = signed.join(labels.withColumnRenamed("id", "of"), F.col("same") == F.col("of"), "left")
    return placed.select("rid", "id", F.coalesce("label", "same", "rid").alias("class"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, the one whose key is smallest as text (then by row name). Columns stay as they are."""
    found = written(classes(docs, key, text, threshold), "dup-classes")
    rid = free_name(docs, "rid")
    kept = found.groupBy("class").agg(F.min(F.struct("id", "rid")).alias("k")).select(F.col("k.rid").alias("rid"))
    gone = found.select("rid").distinct().join(kept, "rid", "left_anti")
    repeated = written(found.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(kept, "rid", "left_semi").select("rid"), "dup-repeated")
    named = with_row_name(docs, key, text, rid)
    once = named.join(small(written(gone.union(repeated), "dup-gone").toDF(rid)), rid, "left_anti")
    again = named.join(small(repeated.toDF(rid)), rid, "left_semi").dropDuplicates([rid])
    return once.unionByName(again).drop(rid)
