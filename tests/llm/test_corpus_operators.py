"""Operators 3, 4, 6, 7 and 8 and the pipeline against plain Python."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import html, jaccard, substrings, topk, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("hot", [64, 2])
def test_substrings(docs, documents, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_CONTEXTS", hot)
    first = {}
    for d, t in documents:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12) if d is not None else ():
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, d), d)
    want = []
    for d, t in documents:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 12) if d is not None else ():
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        want.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert sorted((tuple(r) for r in substrings.digest(docs).collect()), key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 1000
    cut = substrings.apply(docs)
    assert cut.columns == docs.columns and cut.count() == len(documents)
    assert substrings.digest(docs.limit(0)).count() == 0


def largest_batch(spark):
    """Bytes of the largest batch that a Python worker gets of 16 MB of long texts."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    return spark.range(0, 200, 1, 1).selectExpr("repeat('ab ', 27000)").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_substrings_hold_texts_once(spark, docs, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows, whole = [], substrings.remove_repeats
    monkeypatch.setattr(substrings, "remove_repeats", lambda *a, **b: rows.append(cut := whole(*a, **b)) or cut)
    assert substrings.digest(docs).count() == substrings.apply(docs).count()
    assert [r.schema["row"].dataType.names for r in rows] == [["doc_id"], ["doc_id", "lang", "source", "n", "words"]]
    assert largest_batch(spark) < 5_000_000


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("short, frequent", [(8, 65536), (2, 5)])
def test_jaccard(docs, documents, monkeypatch, short, frequent):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "FEW_PAIRS", 0 if short == 2 else 16)
    monkeypatch.setattr(jaccard.frequent_shingles, "__defaults__", (5, frequent))
    sets = [shingles(t) for _, t in documents]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = defaultdict(int)
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            for j in held[g]:
                shared[j, i] += 1
            held[g].append(i)
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(documents):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(documents)), key=str)
    assert sorted((tuple(r) for r in jaccard.classes(docs).collect()), key=str) == want
    if short == 8:
        kept = jaccard.one_of_each(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len({find(i) for i in range(len(sets)) if sets[i]}) + sum(not s for s in sets)
        assert jaccard.classes(docs.limit(0)).count() == 0


def pages():
    notice = "Welcome to our great site please enjoy your stay here"
    rows = [(i, f"http://h.x/{i}", f"<body><div>{notice}</div><div>Own text {i} " + " ".join(chr(97 + (i * 7 + k * k) % 26) * 3 for k in range(12)) + '</div><div class="cookie-bar">We use cookies</div><ul><li>a<li>b &lt; c</ul></body>') for i in range(20)]
    rows += [(None, None, None), (1, "", ""), (2, "http://u.x/1", "<p>a<p>b<script>x</p>"), (2, "http://u.x/1", "<p>a<p>b<script>x</p>")]
    rows += [(30, "http://v.x/", "<main><header><h1>T</h1></header><p>x &amp; y<br>z</p><form><p>no</p></form><div class='comments'><article>c</article></div><aside>s</aside></main>")]
    rows += [(40 + k, "http://w.x/", "<nav>menu</nav><article><h1>Same  title</h1><p><b>one two three four five six seven eight nine<br><p>end</article><footer>f</footer>") for k in range(9)]
    return rows


def test_html(spark):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html.extract(frame).collect()}
    assert html.extract(frame).count() == len(pages())
    for i in range(20):
        assert got[i, f"http://h.x/{i}"][0].endswith("\na\nb < c") and "Welcome" not in got[i, f"http://h.x/{i}"][0] and f"{i} " in got[i, f"http://h.x/{i}"][0]
    assert got[None, None] == ("", 0) and got[1, ""] == ("", 0) and got[2, "http://u.x/1"] == ("a\nb", 3)
    assert got[30, "http://v.x/"][0] == "T\nx & y z"
    assert got[48, "http://w.x/"][0] == "Same title\none two three four five six seven eight nine\nend"
    assert html.extract(frame.limit(0)).count() == 0


def test_html_of_a_large_host(spark):
    notices = {k: [f"n{k}w{j}" for j in range(10)] for k in (2, 3, 9, 30)}
    bodies = [[f"own{i}x{j}" for j in range(3)] + [w for k, words in notices.items() if i // 7 < k and i % 7 == 0 for w in words] + [f"end{i}"] for i in range(1200)]
    rows = [(i, f"http://big.x/{i}", f"<body><div>{' '.join(words)}</div></body>") for i, words in enumerate(bodies)]
    rows += [(5000 + i, f"http://small{i // 3}.x/{i}", f"<body><div>a{i} {' '.join(notices[3])} b</div></body>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    codes = {}
    tokens = np.array([codes.setdefault(w, len(codes)) for words in bodies for w in words])
    owner = np.repeat(np.arange(1200), [len(words) for words in bodies])
    covered = html.repeated(tokens, owner, html.REPEAT_TOKENS, html.LEAST_PAGES)
    kept = iter(~covered)
    assert [got[i] for i in range(1200)] == [" ".join([w for w in words if next(kept)]) for words in bodies]
    assert sum("n2w0" in got[i] for i in range(1200)) == 2 and not any("n3w0" in x or "n9w0" in x or "n30w0" in x for x in got.values())


def test_html_reader():
    read = lambda page: [(marked, text) for _, marked, text in html.blocks(page)]
    kept = lambda page: " ".join(text for marked, text in read(page) if not marked)
    assert kept('<div style="overflow:hidden">a</div>') == kept('<p title="The hidden valley">a</p>') == kept('<p data-id="menu">a</p>') == "a"
    assert kept('a<svg width="1"/>b') == "ab" and kept("<div><svg><text>no</text></div>b") == "b" and kept("<div><script>no</div>b") == "b"
    assert kept('<div class="notice-board-history">a</div><p id="share-prices">b</p>') == "a b"
    for name in ("cookie-bar", "siteFooter", "ad-slot-3", "page__sidebar--left", "related-posts", "x comments", "notice", "sideBar", "side-bar", "site-header", "header"):
        assert not kept(f'<div class="{name}">no</div>'), name
    assert kept("<p hidden>no</p><p hidden=''>no</p>a") == "a" and kept('<p data-hidden="x" aria-label="menu">a') == "a"
    assert kept("a < b &lt;i&gt; <3 <!-- x > y --> c") == "a < b <i> <3 c" and kept("a <!-- no") == "a" and kept("<p>a<br>b\n\tc<td>d") == "a b c d"
    assert kept('<a title="<nav>x">a</a> b') == "a b" and kept("<p title='a>b'>c") == "c" and kept('<p title="open>c</p>d') == "c d"
    assert kept("<article class='post'>a<article class='comment'>no</article></article>") == "a"
    assert kept("<nav><ul><li>no<li>no</ul></nav>a") == "a" and kept("<nav><table><tr><td></nav>no</table></nav>a") == "a" and kept("<i>a</div></b>b") == "ab"
    assert kept("<main><div class='page-header'>a</div><header>b</header></main>") == "a b" and kept("<div class='article-header'>a</div><header>no</header>b") == "a b"
    assert read("<p>wo<b>r</b>d <i>a</i><span class='ad'>no</span>b</p>c") == [(False, "word ab"), (False, "c")]


def test_html_of_any_length(spark):
    import time

    start = time.time()
    for part in ('<a href="x ', "<div>", "</i>", "<i><div>", "<b>", "<a b='", "<li>", "<script>", "<p ", "<!--", "&", "<table><td>"):
        html.blocks(part * (400_000 // len(part)))
    whole = "<article>" + "<p>word &amp; word</p>" * 250_000 + "</article>"
    odd = spark.createDataFrame([(1, "http://a.x/", whole, "k", 3), (1, None, whole + "<a title='", None, None)], "page_id long, url string, html string, host string, id int").withColumn("text", F.lit("t")).withColumn("open", F.lit(1))
    for r in html.extract(odd).collect():
        assert r["text"] == "\n".join(["word & word"] * 250_000) and r["n_chars"] == len(r["text"])
    assert time.time() - start < 60


def test_repeated_substrings():
    rng = np.random.default_rng(1)
    tokens, page = rng.integers(0, 4, 300), np.repeat(np.arange(10), 30)
    got = html.repeated(tokens, page, 4, 3)
    want = np.zeros(300, bool)
    where = defaultdict(set)
    for i in range(297):
        if page[i] == page[i + 3]:
            where[tuple(tokens[i : i + 4])].add(int(page[i]))
    for i in range(297):
        if page[i] == page[i + 3] and len(where[tuple(tokens[i : i + 4])]) >= 3:
            want[i : i + 4] = True
    assert (got == want).all() and want.any() and not want.all()


@pytest.mark.parametrize("far", [False, True])
def test_topk(spark, monkeypatch, far):
    for name, value in (("BLOCK_ROWS", 37), ("QUERY_ROWS", 5), ("CHUNK", 7), ("PIVOTS", (9, 12))):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(i, [0.0] * 8) for i in range(200, 230)] + [(i, [1.0] * 8) for i in range(230, 280)]
    rows += [(20, [1.5] * 8), (20, [1.5] * 8), (21, [1.5] * 8), (21, [0.5] * 8)]  # repeated ids
    rows += [(300, None), (320, [float("nan")] * 8), (None, [1.0] * 8), (340, [None] + [1.0] * 7), (360, [float("inf")] + [1.0] * 7)]
    if far:
        rows += [(380, [1e6] + [3.0] * 7), (381, [1e6, -3e6] + [3.0] * 6)]
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (i, v) in enumerate(good):
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, (j, w) in enumerate(good) if m != n)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).withColumn("cell", F.lit("clash"))
    assert sorted(tuple(r) for r in topk.search(frame, F.col("vec_id") % 20 == 0).collect()) == sorted(want)
    if not far:
        empty = spark.createDataFrame([(i, []) for i in range(30)], "vec_id long, embedding array<float>")
        assert {(r["query_id"], r["score"]) for r in topk.search(empty, F.col("vec_id") % 20 == 0).collect()} == {(0, 0), (20, 0)}
        assert topk.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
        assert topk.search(frame.where("vec_id in (0, 1)").dropDuplicates(["vec_id"]), F.col("vec_id") % 20 == 0).count() == 1


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model).join(labels, "doc_id").withColumn("held_out", toxicity.held_out()).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    toxic, clean = ([r["score"] for r in scored if r["held_out"] and r["toxic"] == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.75 and np.mean([s >= 0.3 for s in clean]) < 0.05
    odd = spark.createDataFrame([(1, None, 5), (None, "", 5), (1, "x" * 600000, 5), (2, "x" * 600000, 5)], "doc_id long, text string, _score int")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["score"] == rows[1]["score"]
    assert toxicity.score(docs.limit(0), model).count() == 0
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in toxicity.score(docs, model).collect())


def test_columns_of_any_name(spark, docs):
    names = ["_id", "_key", "_first", "_score", "_kept", "_runs", "_d", "_k", "row", "kept", "runs", "score", "key", "first", "id", "d", "root", "a`b", "_text"]
    odd = docs.select("doc_id", "text", *[F.concat(F.lit(f"{n} "), F.coalesce("text", F.lit(""))).alias(n) for n in names])
    whole = sorted((tuple(r) for r in odd.collect()), key=str)
    model = toxicity.fit(["abcabcabc", "xyzxyzxyz"] * 9, np.array([True, False] * 9))
    assert sorted((tuple(r) for r in toxicity.keep(odd, model, 1.1).collect()), key=str) == whole
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and {tuple(r) for r in kept.collect()} <= set(whole)
    cut = substrings.apply(odd)
    assert cut.columns == odd.columns and sorted((tuple(r)[2:] for r in cut.collect()), key=str) == sorted((r[2:] for r in whole), key=str)


def test_learning_is_bounded(spark):
    rows = [(i, ("bad words here " if i % 2 else "good words there ") * (3 + i)) for i in range(60)]
    docs = spark.createDataFrame(rows + [(100, "x" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(100, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, max_chars=40_000)
    chosen = [(i, t) for i, t in rows if i not in (7,)]
    # 8 has a label besides the null one, so it counts; 7 has both labels and doesn't
    same = toxicity.fit([t for _, t in chosen], np.array([i % 2 == 1 for i, _ in chosen]))
    more = toxicity.train(docs.where("doc_id < 100"), labels)
    assert np.array_equal(more.names, same.names) and np.allclose(more.values, same.values) and math.isclose(more.bias, same.bias)
    assert toxicity.predict(model, ["bad words here"])[0] > 0.5 > toxicity.predict(model, ["good words there"])[0]
    none = toxicity.train(docs, labels, max_chars=0)
    assert not len(none.names) and toxicity.train(docs.limit(0), labels).bias == toxicity.fit([], np.zeros(0, bool)).bias


def test_features():
    texts = ["abcabc", None, "", "abc", "xyzw"]
    pairs = {(lo + int(d), int(g)) for lo, _, doc, gram in toxicity.features(texts) for d, g in zip(doc, gram, strict=True)}
    of = lambda i: {g for d, g in pairs if d == i}
    assert of(3) < of(0) and not of(1) and not of(2) and len(of(3)) == 1 and len(of(4)) == 3
    flat = toxicity.fit([], np.zeros(0, bool))
    assert toxicity.predict(flat, ["a"])[0] < 0.3


def test_pipeline(spark):
    """The stages together; each of them is compared with plain Python in test_stages."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs, sizes = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < 200 and sizes[-1] > 100
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op4_ngram_jaccard", "op7_exact_topk", "op9_quality_rules", "op10_license_scans", "op11_fill_in_middle", "op12_filter_audit", "op13_sharding"])
def test_against_sql(spark, name):
    import duckdb

    from glyphlake.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=str) == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
