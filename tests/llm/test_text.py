"""Decontamination, secrets, HTML, toxicity, quality and near duplicates against plain Python."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from coppice.llm import decontaminate, html_text, neardup, quality, queries, secrets, toxicity
from coppice.llm import words as W
from conftest import prose

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def lowered_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_hits(text, items, width=10):
    words = lowered_words(text)
    hit, found = set(), set()
    for item, body in items:
        own = lowered_words(body)
        k = min(width, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1 if windows else 0):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    seen = 0
    for r in queries.decontaminate_documents(spark, MEDIUM).collect():
        n, hit, found = plain_hits(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest() and r.contaminated == (hit > 0)
        seen += r.contaminated
    assert seen > 0


def test_short_items_and_blocks(spark, odd_rows, no_rows):
    docs = spark.createDataFrame([(1, "A b c d é b c"), (2, "x"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "B, c"), (11, None), (None, "é"), (12, "c d é b c d e f g h i")], "item_id long, text string")
    for size in (1 << 20, 4):
        got = {r.doc_id: (r.hits.n_hit, r.hits["items"]) for r in decontaminate.mark_contamination(docs, items, block_bytes=size).collect()}
        assert got == {1: (5, ["", "10"]), 2: (0, []), 3: (0, [])}
    assert decontaminate.mark_contamination(odd_rows, items).count() == odd_rows.count()
    assert decontaminate.mark_contamination(odd_rows, items.limit(0)).where("hits.n_hit > 0").isEmpty()
    assert decontaminate.mark_contamination(no_rows, items).isEmpty()


def plain_secrets(text):
    found = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m.group(1)) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_secrets_match_plain_patterns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    total = 0
    for r in queries.scan_secrets(spark, MEDIUM).collect():
        want = plain_secrets(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert set(want) <= set(r.spans.split(",")) or not want
        total += len(want)
    assert total > 10


def test_automaton_learns_a_format():
    rng = np.random.default_rng(3)
    keys = ["K" + "".join(rng.choice(list("0123456789abcdef"), 20)) for _ in range(400)]
    learned = secrets.Automaton([secrets.classes(k) for k in keys[:300]])
    assert len(learned.states) < 60  # thousands of tree states fold to a few
    inside = np.mean([learned.bits(secrets.classes(k)) for k in keys[300:]])
    assert inside > learned.bits(secrets.classes("wonderfullyordinaryword")) + 1
    model = secrets.FormatModel({0: keys}, [prose(i, 1) * 6 for i in range(200)])
    assert model.score("K0a1b2c3d4e5f60718293")[1] and not model.score("wonderfullyordinaryword1")[1]


def test_odd_rows_are_scanned(odd_rows, no_rows):
    assert secrets.scan(odd_rows).count() == odd_rows.count()
    assert secrets.scan(no_rows).isEmpty()


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_positions_are_longest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()
        got = html_text.common_positions(a, b)
        assert len(got) == plain_lcs(a, b) and got == sorted(got)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in got))


def test_article_text():
    html = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="cookie-notice">We use</div>
    <article><header><h1>Head &amp; tail</h1></header><p>One <b>two</b>\n three<br>four<p>Five<script>var x = "</p>";</script> six</p>
    <aside>Side</aside><form>Name</form><ul><li>Item</li></ul><section id="comments"><p>Reader</p></section></article>
    <div class="ad">Buy</div><footer>&copy; x</footer></body></html>"""
    lines = html_text.page_lines(html)
    assert [t for t, k in lines if k == html_text.CONTENT] == ["Head & tail", "One two three four", "Five six", "Item"]
    assert html_text.page_lines(None) == [] and html_text.page_lines("a < b") == [("a < b", html_text.NEUTRAL)]


def test_pages_without_an_article_are_differenced(spark):
    page = "<div>Site name</div><div>{0}</div><div>{1}</div><div>Imprint</div>"
    rows = [(i, f"http://h.example/a/{i}", page.format(prose(i, 9), prose(i + 50, 9))) for i in range(4)]
    rows += [(9, "http://alone.example/", page.format("x", "y")), (None, None, None), (10, "rel", "<p>t")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{prose(i, 9)}\n{prose(i + 50, 9)}" for i in range(4))
    assert got[9] == "Site name\nx\ny\nImprint" and got[None] == "" and got[10] == "t"


def test_articles_keep_blocks_whose_names_only_resemble_furniture():
    kept = "".join(f'<p class="{c}">{c}</p>' for c in ("share-price", "social-history", "widget-image", "commentary", "adverse-effects"))
    gone = "".join(f'<div id="{c}">gone</div>' for c in ("share-buttons", "commentList", "ad", "newsletter-signup", "cookie-notice"))
    lines = html_text.page_lines(f'<article>{gone}{kept}<p id="notice-period">N</p></article>')
    assert [t for t, k in lines if k == html_text.CONTENT] == ["share-price", "social-history", "widget-image", "commentary", "adverse-effects", "N"]


def test_copies_of_unmarked_pages_keep_their_text(spark):
    page = "<div>Site name</div><div>{0}</div><div>Imprint</div>"
    rows = [(i, f"http://h.example/a/{i}", page.format(prose(i // 3, 9))) for i in range(9)] + [(20, "http://h.example/a/1", page.format(prose(0, 9)))]
    rows += [(i, f"http://twins.example/{i}", page.format("only")) for i in (30, 31)]
    frame = spark.createDataFrame([(*r, "x", True) for r in rows], "page_id long, url string, html string, lines string, shared boolean")
    got = {r.page_id: r.text for r in html_text.extract(frame).collect()}
    assert all(got[i] == prose(i // 3, 9) for i in range(9)) and got[20] == prose(0, 9)
    assert got[30] == got[31] == "Site name\nonly\nImprint" and len(got) == len(rows)
    assert html_text.extract(frame.limit(0)).isEmpty()


def test_hostile_pages_take_time_in_proportion():
    import time
    for piece, end in (('<div class="x', ""), ("<a ", ""), ("<a b='>", ""), ('<a "', ">"), ("<a<", ""), ("<!--", ""), ("<![CDATA[", "")):
        start = time.perf_counter()
        html_text.page_lines(piece * 40_001 + end)
        assert time.perf_counter() - start < 3, piece
    start = time.perf_counter()
    html_text.page_lines("<b>" * 5000 + "</x>" * 20_000)
    assert time.perf_counter() - start < 3
    assert html_text.page_lines("<p>a <!-- b") == [("a", html_text.NEUTRAL)] and html_text.page_lines("a <b c") == [("a", html_text.NEUTRAL)]


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = [prose(3, 500), "", None, "Ünïcode Ärger ünïcode", prose(4, 2000)]
    whole = W.word_hashes(texts)
    monkeypatch.setattr(W, "BLOCK", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, W.word_hashes(texts), strict=True))
    assert [len(h) for h in whole] == [len((t or "").split()) for t in texts]
    assert whole[3][0] == whole[3][2]


@pytest.mark.parametrize("name,label,score", [("op3_quality_classifier", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, score):
    got = queries.QUERIES[name](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in got]) >= score


def plain_gaps(rows, discount):
    """Interpolated Kneser-Ney over distinct left neighbours, word by word."""
    seen = {0: {}, 1: {}}
    for text, label in rows:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        for left, word in zip([None, *words], words):
            seen[label].setdefault(word, set()).add(left)
    words = seen[0].keys() | seen[1].keys()
    count = {w: [len(seen[y].get(w, ())) for y in (0, 1)] for w in words}
    shared = sum(a + b + 0.5 for a, b in count.values())
    kept = [sum(max(c[y] - discount, 0) for c in count.values()) for y in (0, 1)]
    back = max(1 - kept[y] / sum(c[y] for c in count.values()) for y in (0, 1))

    def p(w, y):
        return (1 - back) * max(count[w][y] - discount, 0) / max(kept[y], 1) + back * (sum(count[w]) + 0.5) / shared

    return {w: float(np.log(p(w, 1)) - np.log(p(w, 0))) for w in words}


def test_kneser_ney_matches_brute_force(spark):
    rows = [(prose(i, 30) + (" vile ga vile ho vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)] + [(None, 0), ("", 1)]
    want = plain_gaps(rows, 2.0)
    df = spark.createDataFrame(rows, "text string, label int")
    counts = toxicity.context_counts(df, "text")
    got = {np.int64(r.word).view(np.uint64): r.gap for r in toxicity.likelihood_gaps(counts, 2.0).collect()}
    names = {w: W.word_hashes([w])[0][0] for w in want}
    assert counts.count() == len(want) and all(abs(got.get(names[w], 0.0) - g) < 1e-5 for w, g in want.items())
    assert want["vile"] > 1 and any(g < -0.1 for g in want.values())


def test_joined_words_score_as_broadcast_ones(spark, odd_rows):
    words = sorted(set(prose(4, 400).split()))
    gaps = spark.createDataFrame([(int(W.word_hashes([w])[0][0].view(np.int64)), i / 50 - 2) for i, w in enumerate(words)], "word long, gap float")
    frame = odd_rows.select("doc_id", "text")
    small, joined = (sorted((str(r.doc_id), str(r.text), [round(x, 9) for x in r.f]) for r in toxicity.with_features(frame, gaps, len(words), "text", "f", bound).collect())
                     for bound in (10**6, 0))
    assert small == joined and any(f[0] for _, _, f in small)


def test_rare_words_favour_no_class(spark):
    counts = spark.createDataFrame([(1, 40, 0), (2, 1, 0), (3, 0, 1), (4, 60, 900)], "word long, toxic long, ordinary long")
    gaps = {r.word: r.gap for r in toxicity.likelihood_gaps(counts).collect()}
    assert gaps[1] > 2 and gaps[4] == pytest.approx(np.log((94.0 / 101 * 57 / 94 + 7 / 101 * 960.5 / 1004) / (94.0 / 101 + 7 / 101 * 960.5 / 1004)), abs=1e-5) and set(gaps) == {1, 4}


def test_odd_rows_are_scored(spark, odd_rows, no_rows, some_labels):
    from pyspark.sql import functions as F
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        for frame in (odd_rows, no_rows):
            model = module.fit(frame, some_labels, F.lit(False))
            got = module.score(frame, model, out="score")
            assert got.count() == frame.count() and got.columns.count("score") == 1
            assert got.where("score is null or score < 0 or score > 1").isEmpty()
        empty = module.fit(odd_rows, some_labels.limit(0), F.lit(False))
        assert module.score(odd_rows, empty).count() == odd_rows.count()


def plain_classes(texts, threshold=0.8):
    sets = [set(neardup.shingles(w, 5).tolist()) for w in W.word_hashes(texts)]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= threshold * len(a | b):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").orderBy("doc_id").collect()]
    plain = plain_classes([t for _, t in docs])
    got = {r.doc_id: r.class_id for r in queries.near_duplicates(spark, MEDIUM).collect()}
    groups, wanted = {}, {}
    for (key, _), label in zip(docs, plain, strict=True):
        groups.setdefault(got[key], set()).add(key)
        wanted.setdefault(label, set()).add(key)
    merged = {frozenset(g) for g in groups.values()}
    assert all(any(w <= g for g in merged) for w in wanted.values())  # no link of the plain similarity is lost
    assert len(merged) >= len(wanted) * 0.98


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    sampler = neardup.Sampler(np.ones(neardup.BUCKETS, dtype=np.float32))
    agree = []
    for _ in range(60):
        common, one, two = (np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (160, 20, 20))
        a, b = np.unique(np.concatenate([common, one])), np.unique(np.concatenate([common, two]))
        agree.append(np.mean(sampler.samples(a, np.ones(len(a), np.float32)) == sampler.samples(b, np.ones(len(b), np.float32))))
    assert abs(np.mean(agree) - 0.8) < 0.03


@pytest.mark.parametrize("block", [1024, 7])
def test_large_buckets_lose_no_link(spark, monkeypatch, block):
    """One bucket held mostly by one group; two other members are alike, two are alike only to the bound, one is alone."""
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    group, pair, less = list(range(100)), list(range(200, 300)), list(range(400, 500))
    texts = {i: group for i in range(1, 81)} | {101: pair, 102: pair[:-8] + list(range(300, 308)), 103: less, 104: less[:-14] + list(range(500, 514)), 105: list(range(600, 700))}
    sets = spark.createDataFrame([(i, sorted(x), [1] * len(x)) for i, x in texts.items()], "id long, shingles array<long>, counts array<int>")
    crowded = spark.createDataFrame([(7, i, 100, 100.0) for i in texts], "band long, id long, n long, w double")
    sampler = spark.sparkContext.broadcast(neardup.Sampler(np.ones(neardup.BUCKETS, dtype=np.float32)))
    labels = {r.id: r.label for r in neardup.link_buckets(crowded, sets, sampler, 0.8).collect()}
    assert labels == {i: 1 for i in range(1, 81)} | {101: 101, 102: 101}


def test_one_of_each_group_stays(spark, odd_rows, no_rows):
    base = prose(11, 80)
    near = base.replace(base.split()[40], "changed", 1)
    rows = [(1, base), (2, base), (3, near), (3, near), (4, prose(12, 80)), (5, None), (6, ""), (7, ""), (None, base)]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) in ([4, 5, 6], [4, 5, 7], [1, 4, 5, 6]) and len(kept) == 4
    assert neardup.keep_one(odd_rows).columns == odd_rows.columns
    assert neardup.keep_one(no_rows).isEmpty()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.subtract(docs).isEmpty()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()}
    assert clean == {r.doc_id for r in docs.collect() if not plain_hits(r.text, items)[1]}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
