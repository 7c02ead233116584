"""Filter and source audits against SQL and plain Python, byte pairs against the public library."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import prose
from harness import compare, connect

from coppice.llm import byte_pairs, filter_audit, queries, source_audit

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_filter_interaction"])
def test_audits_match_their_sql(spark, name):
    rows, problems = compare(spark, connect(MEDIUM), queries.QUERIES[name], queries.ORACLES[name], MEDIUM)
    assert rows and not problems


def plain_filter_audit(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic)."""
    counts = Counter()
    for key, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "".join(letter for letter, failed in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search("[#$%&*|]", text),
            key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows)), strict=True) if failed)
        good = key is not None and any(i == key and q == 1 for i, q, _ in labels)
        bad = key is not None and any(i == key and x == 1 for i, _, x in labels)
        counts[lang or "", fails, good, bad] += 1
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    for (part, fails, good, bad), n in counts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                gone, hit = set(order[: step - 1]) & set(fails), letter in fails
                cell = out[part, order, step]
                for place, yes in enumerate((not gone and not hit, not gone and hit, gone and hit, fails == letter, not gone and hit and good, not gone and hit and bad)):
                    cell[place] += n if yes else 0
                shapley[part, letter] += n if hit and not gone else 0
    return {(part, order, step, *cell, shapley[part, order[step - 1]]) for (part, order, step), cell in out.items()}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit_on_odd_rows(spark, odd_rows, no_rows, some_labels):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_rows.collect()]
    labels = [tuple(r) for r in some_labels.collect()]
    got = {tuple(r) for r in filter_audit.audit(odd_rows, some_labels).select(COLUMNS).collect()}
    assert got == plain_filter_audit(rows, labels) and filter_audit.audit(no_rows, some_labels).isEmpty()
    assert filter_audit.audit(odd_rows, some_labels.limit(0)).where("good_lost > 0 or toxic_lost > 0").isEmpty()


def test_large_groups_of_copies(spark, monkeypatch, some_labels):
    """Copies of one text over several pieces, each with the smallest key outside its own piece; ties of hash do not count."""
    text, other = prose(1, 120), prose(2, 120)
    rows = [(i, text if i % 3 else other, "en") for i in range(600)] + [(0, other, "de"), (7000, text.upper(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = [tuple(r) for r in some_labels.collect()]
    want = plain_filter_audit(rows, labels)
    assert {tuple(r) for r in filter_audit.audit(docs, some_labels).select(COLUMNS).collect()} == want
    monkeypatch.setattr(filter_audit, "SMALL_SIDE", 0)
    assert {tuple(r) for r in filter_audit.audit(docs, some_labels).select(COLUMNS).collect()} == want


def test_source_audit_on_odd_rows(spark, odd_rows, no_rows):
    rows = [(r.text or "", r.lang or "", r.source or "") for r in odd_rows.collect()]
    for least in (2, 10_000):
        used = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) for text, lang, source in rows]
        docs = Counter((lang, w) for lang, _, words in used for w in set(words))
        kept = defaultdict(list)
        for (lang, w), n in docs.items():
            if n >= least:
                kept[lang].append(w)
        counts = defaultdict(Counter)
        for lang, source, words in used:
            counts[lang, source].update(w for w in words if docs[lang, w] >= least)
        share = {g: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept[g[0]])) for w in kept[g[0]]} for g, c in counts.items()}
        want = set()
        for lang, source in counts:
            near = sorted(((-sum(abs(share[lang, source][w] - share[lang, s][w]) for w in kept[lang]), s.encode(), s) for x, s in counts if x == lang and s != source))
            want |= {(lang, source, "pair", s, -v, i) for i, (v, _, s) in enumerate(near, 1)}
            whole = sum((c for (x, _), c in counts.items() if x == lang), Counter())
            usual = {w: 1 + 10**9 * (whole[w] + 5) // (sum(whole.values()) + 5 * len(kept[lang])) for w in kept[lang]}
            more = sorted((usual[w] - p, w.encode(), w) for w, p in share[lang, source].items() if counts[lang, source][w] and p > usual[w])[:50]
            want |= {(lang, source, "term", w, -v, i) for i, (v, _, w) in enumerate(more, 1)}
        got = source_audit.audit(odd_rows, min_docs=least).select("lang", "source", "part", "item", "value", "rank").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert source_audit.audit(no_rows).isEmpty()


def test_terms_of_a_group_are_summed_where_its_documents_meet(spark):
    """Vectors, not their entries, are brought together by group; groups that differ in one column stay apart."""
    rows = [("a b a C", "en", "x"), ("a b a C", "en", "x"), ("b b", "en", ""), ("c", "", "x"), ("", "en", "x"), ("rare", "en", "x")]
    summed, vocabulary = source_audit.group_counts(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3), 2)
    assert "REBALANCE_PARTITIONS_BY_COL" in summed._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in summed.join(vocabulary, "term").select("lang", "source", "item", "n", "docs").collect())
    assert got == [("", "x", "c", 1, 1), ("en", "", "b", 2, 1), ("en", "x", "a", 4, 2), ("en", "x", "b", 2, 2), ("en", "x", "c", 2, 2)]


def library():
    coder = byte_pairs.Coder(RANKS, public_tokenizers.PATTERN)
    return coder, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(700))
    return ["", None, " " * 5000, "a" * 3000, "\n\n \t  x", "naïve 日本語テキスト🎉🎉", letters, letters[:64], letters[:63], "<|endoftext|> hi", "aaa aaaa aaaaa  aaaaaaa",
            "0" * 999, "ab" * 500, "!?" * 300, "=-=-" * 200, "\0\x7f ", prose(5, 20_000)]


@pytest.mark.parametrize("characters,word_bytes", [(4_000_000, 1 << 20), (2000, 500)])
def test_tokens_are_the_librarys(monkeypatch, characters, word_bytes):
    monkeypatch.setattr(byte_pairs, "CHARACTERS", characters)
    monkeypatch.setattr(byte_pairs, "WORD_BYTES", word_bytes)
    monkeypatch.setattr(byte_pairs, "MATCHES", 100)
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 3000)
    coder, public = library()
    encoder = byte_pairs.Encoder(coder.ranks, byte_pairs.merge_table(coder.ranks), coder.pattern)
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet'").fetchall()] + odd_texts()
    got = [ids for part in encoder.encode(texts) for ids in part]
    assert [list(ids) for ids in got] == [public.encode_ordinary(t or "") for t in texts]


def test_round_trip_keeps_rows(spark, odd_rows, no_rows):
    coder, public = library()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd_texts())], "doc_id long, text string, decoded int")
    encoded = coder.encode(docs)
    back = {r.doc_id: r for r in coder.decode(encoded).collect()}
    assert all(bytes(back[i].decoded).decode() == (t or "") and list(back[i].ids) == public.encode_ordinary(t or "") for i, t in enumerate(odd_texts()))
    assert coder.encode(odd_rows).count() == odd_rows.count() and coder.encode(no_rows).isEmpty()
    lists = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [31373], "z")], "k int, ids array<int>, decoded string")
    got = {r.k: (r._decoded if r._decoded is None else bytes(r._decoded), r.decoded) for r in coder.decode(lists).collect()}
    assert got == {1: (None, "x"), 2: (b"", "y"), 3: (public.decode_bytes([31373]), "z")}
    with pytest.raises(Exception, match="not in the vocabulary"):
        coder.decode(lists.selectExpr("array(99999) AS ids")).collect()


def test_query_matches_the_library(spark):
    import hashlib
    _, public = library()
    got = {r.doc_id: r for r in queries.QUERIES["op13_byte_pairs"](spark, SMALL).collect()}
    texts = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SMALL}/documents.parquet'").fetchall()
    assert len(got) == len(texts)
    for key, text in texts:
        ids = public.encode_ordinary(text)
        assert (got[key].n_tokens, got[key].ids_sha256, got[key].decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_batched_contractions_are_safe():
    """Equal pairs contracted in one round give what one pair a round gives, also for made ranks of any order."""
    rng = random.Random(4)
    pieces = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))).encode() for _ in range(25)})
    rng.shuffle(pieces)
    ranks = {bytes([b]): b for b in range(256)} | {p: 256 + i for i, p in enumerate(pieces)}
    encoder = byte_pairs.Encoder(ranks, byte_pairs.merge_table(ranks), ".+")
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(64, 90))).encode() for _ in range(40)]

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    tokens, sizes = encoder.contracted(words)
    assert [list(t) for t in np.split(tokens, np.cumsum(sizes)[:-1])] == [plain(w) for w in words]
