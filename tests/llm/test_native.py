"""Sharding, mixing, licence scan and quality rules against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from coppice.llm import licences, mixing, outliers, queries, sharding
from coppice.llm.common import whole_text

SMALL = "/root/testdata/sf0.001"


def plain_shard(key, shards):
    first = xxhash.xxh64(str(key).encode(), seed=42).intdigest()
    scores = []
    for s in range(shards):
        h = xxhash_int(s, first)
        scores.append(-1 / math.log(((h >> 11) + 0.5) / (1 << 53)))
    return max(range(shards), key=lambda s: (scores[s], -s))


def xxhash_int(value, seed):
    """The 64-bit hash of one 4-byte integer as Spark chains it."""
    mask = (1 << 64) - 1
    p1, p2, p3, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    h = (seed + p5 + 4) & mask
    h ^= ((value & 0xFFFFFFFF) * p1) & mask
    h = ((((h << 23) | (h >> 41)) & mask) * p2 + p3) & mask
    h = ((h ^ (h >> 33)) * p2) & mask
    h = ((h ^ (h >> 29)) * p3) & mask
    return h ^ (h >> 32)


def test_shards_match_plain_rendezvous(spark):
    rows = queries.shard(spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == plain_shard(r.doc_id, 40)
        assert r.grown_shard == plain_shard(r.doc_id, 41) and r.grown_shard in (r.shard, 40)
        data = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_attract_rows(spark):
    df = sharding.assign_shards(spark.range(20_000), "id", [1.0, 3.0])
    assert abs(df.where("shard = 1").count() / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.assign_shards(df, "id", [0.0])


def test_hot_key_slots(spark):
    df = spark.range(3000).select(F.lit(7).alias("k"), F.lit(0).alias("shard")).union(spark.range(5).select(F.col("id").cast("int"), F.lit(0)))
    got = sharding.number_slots(df, "shard", ["k"])
    assert sorted(r.slot for r in got.collect()) == list(range(3005))


def test_odd_rows_are_sharded(odd_rows, no_rows):
    got = sharding.assign_shards(odd_rows, "doc_id", [1.0] * 4)
    assert got.count() == odd_rows.count() and got.where("shard is null").isEmpty() and dict(got.dtypes)["shard"] == "int"
    assert sharding.assign_shards(no_rows, "doc_id", [1.0]).isEmpty()


def test_raking_matches_plain_fit(spark):
    got = queries.mix_sources(spark, SMALL).collect()
    tokens = defaultdict(float)
    for r in got:
        tokens[(r.source, r.lang, r.topic)] += r.tokens + 1
    cells = list(tokens)
    total = sum(tokens.values())
    targets = []
    for d in range(3):
        sums = Counter()
        for c in cells:
            sums[c[d]] += tokens[c]
        power = {k: v**0.9 for k, v in sums.items()}
        targets.append({k: v / sum(power.values()) for k, v in power.items()})
    w = {c: tokens[c] / total for c in cells}
    for _ in range(300):
        for d in range(3):
            sums = Counter()
            for c in cells:
                sums[c[d]] += w[c]
            w = {c: w[c] * targets[d][c[d]] / sums[c[d]] for c in cells}
    ratio = {c: w[c] / tokens[c] for c in cells}
    top = max(ratio.values())
    for r in got:
        assert r.probability == pytest.approx(ratio[(r.source, r.lang, r.topic)] / top, abs=1e-4)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert all(r.tokens == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id])) for r in got)


def test_explicit_targets(spark):
    df = spark.createDataFrame([(i, "w w w", "a" if i % 4 else "b") for i in range(400)], "id long, text string, s string")
    wanted = {"s": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "s string, target double")}
    by = {r.s: r.p for r in mixing.mix(df, "id", "text", ["s"], targets=wanted).groupBy("s").agg(F.max("probability").alias("p")).collect()}
    assert by["b"] == pytest.approx(1.0) and by["a"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        mixing.mix(df, "id", "text", ["s"], targets={"s": wanted["s"].where("s = 'a'")})


def test_odd_rows_are_mixed(odd_rows, no_rows):
    got = mixing.mix(odd_rows.withColumn("topic", mixing.topic_of(whole_text())), "doc_id", "text", ["source", "lang", "topic"])
    assert got.count() == odd_rows.count() and got.where("probability is null or probability > 1 or sampled is null").isEmpty()
    assert mixing.mix(no_rows, "doc_id", "text", ["source"]).isEmpty()


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {p + j for places in windows.values() if len(places) > 1 for p in places for j in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_statistics_match_plain(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.quality_rules(spark, SMALL).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_stats(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_scatter_is_robust(spark):
    """A tenth of far rows moves a plain covariance; the determinant estimate stays with the bulk."""
    rng = np.random.default_rng(0)
    good = rng.multivariate_normal([1, 2], [[1, 0.6], [0.6, 1]], 3000)
    bad = rng.normal([9, -7], 0.3, (300, 2))
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in np.vstack([good, bad])], "__group string, x double, y double")
    floors = {"x": 0.05, "y": 0.05}
    scatter = outliers.fit_scatter(rows, floors, 0.75, 4)
    far = outliers.with_distance(rows, scatter, list(floors), "d2", "left", "scale").withColumn("d", F.col("d2") * F.col("scale"))
    assert far.where("x > 6 and d < 30").isEmpty()
    assert far.where("x < 6 and d > 30").count() <= 3
    m = scatter.first()
    assert abs(m.m_0 - 1) < 0.1 and abs(m.m_1 - 2) < 0.1


def test_small_sources_are_judged_by_their_language(spark):
    """A source of junk alone, and one of many rows of which few are sound, do not make their own centre."""
    from conftest import prose
    junk = lambda i: " ".join(f"{w}#$%&|<>*#$%&" for w in prose(i, 40).split())
    rows = [(i, prose(i, 60 + i % 40), "en", "large") for i in range(260)]
    rows += [(1000 + i, junk(i), "en", "small") for i in range(5)] + [(2000, prose(2000, 70), "en", "lone")]
    rows += [(3000 + i, "too short", "en", "failing") for i in range(220)] + [(4000 + i, junk(90 + i), "en", "failing") for i in range(3)]
    rows += [(5000, junk(99), "de", "other")]
    kept = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[i] for i in (*range(1000, 1005), *range(4000, 4003), 5000))
    assert kept[2000] and sum(kept[i] for i in range(260)) >= 255


def test_odd_rows_are_judged(odd_rows, no_rows):
    got = outliers.judge(odd_rows).collect()
    assert len(got) == odd_rows.count() and all(r.kept is not None for r in got)
    assert {r.doc_id for r in got if r.n_words == 0} >= {1, 2, 6}
    assert outliers.judge(no_rows).isEmpty()


def test_licences_are_found(spark, odd_rows, no_rows):
    from conftest import prose
    rows = [(1, prose(5, 30) + "\nReleased under the MIT License.\n" + prose(6, 20)), (2, "Licensed under CC BY-NC 4.0."), (3, prose(7, 50)),
            (4, "She spoke of the public and of version two."), (5, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows + [(100 + i, prose(i, 60)) for i in range(60)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(df).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("mit", "cc-by-nc", "", "", "apache,mit")
    assert not any(v for k, v in got.items() if k >= 100)
    assert licences.scan(odd_rows).count() == odd_rows.count()
    assert licences.scan(no_rows).isEmpty()


def test_licence_lines_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in queries.scan_licences(spark, "/root/testdata/sf0.01").collect():
        assert bool(r.licences) == bool(re.search(r"(?m)^(Licensed under|Released under|This work is licensed)", docs[r.doc_id]))
