"""Every stage of the pipeline, on texts with nulls, copies, repeats and odd columns, against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glyphlake.llm import packing, quality, toxicity
from glyphlake.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")
STAGES = dict(corpus_pipeline.STAGES)
MASK = (1 << 64) - 1


def grams(text):
    """Hashed n-grams of a text, one at a time."""
    codes, out = [ord(c) & 0xFFFF for c in (text or "").lower()], set()
    for n in toxicity.SIZES:
        for i in range(len(codes) - n + 1):
            rolled = int(toxicity._CHAR[codes[i]])
            for c in codes[i + 1 : i + n]:
                rolled = (rolled * int(toxicity._STEP) + int(toxicity._CHAR[c])) & MASK
            out.add((((rolled ^ (rolled >> 29)) * 0xBF58476D1CE4E5B9) & MASK) >> (64 - toxicity.BITS))
    return out


def learned(texts, toxic):
    """The model by plain loops over its definition: log-count ratios, then full gradient steps."""
    sets, n, bad = [grams(t) for t in texts], len(texts), sum(toxic)
    p, q = Counter(g for s, y in zip(sets, toxic, strict=True) if y for g in s), Counter(g for s, y in zip(sets, toxic, strict=True) if not y for g in s)
    ratio = {g: math.log((p[g] + 1) / (bad + 2)) - math.log((q[g] + 1) / (n - bad + 2)) for g in {*p, *q}}
    least = min(toxicity.LEAST_TEXTS, max(3, n // toxicity.SHARE))
    used = {g: r for g, r in ratio.items() if p[g] + q[g] >= least and abs(r) >= toxicity.LEAST_RATIO}
    bias, weight = math.log((bad + 0.5) / (n - bad + 0.5)), dict.fromkeys(used, 0.0)
    first, second = Counter(), Counter()
    for k in range(1, 151):
        error = [1 / (1 + math.exp(-(bias + sum(used[g] * weight[g] for g in s if g in used)))) - y for s, y in zip(sets, toxic, strict=True)]
        slope = {g: 2e-4 * weight[g] for g in used} | {None: sum(error) / n}
        for s, e in zip(sets, error, strict=True):
            for g in s & used.keys():
                slope[g] += used[g] * e / n
        for g, d in slope.items():
            first[g], second[g] = 0.9 * first[g] + 0.1 * d, 0.999 * second[g] + 0.001 * d * d
            step = 0.05 * first[g] / (1 - 0.9**k) / (math.sqrt(second[g] / (1 - 0.999**k)) + 1e-8)
            if g is None:
                bias -= step
            else:
                weight[g] -= step
    return bias, {g: used[g] * weight[g] for g in used}


def judged(text, model):
    bias, weights = model
    return 1 / (1 + math.exp(-(bias + sum(weights.get(g, 0.0) for g in grams(text)))))


def toxic_rows():
    rows = [(i, f"{'idiot garbage talk' if i % 3 == 0 else 'kind calm words'} number {i} {'again ' * (i % 4)}") for i in range(48)]
    return rows + [(100, None), (None, "idiot garbage"), (None, ""), (101, "idiot garbage talk"), (101, "idiot garbage talk"), (102, "plain İß text " * 500)]


def test_toxicity_stage(spark, tmp_path):
    rows = toxic_rows()
    labels = [(i, int(i % 3 == 0)) for i in range(48)] + [(None, 1), (100, 0), (101, None), (5, 1), (102, 0)]  # 5 has both labels
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, row string")
    seen = [(i, y) for i, y in labels if i is not None and y is not None and i != 5 and zlib.crc32(str(i).encode()) % 4 != 2]
    texts = dict(rows[:48]) | {100: None, 102: rows[-1][1]}
    want = learned([texts[i] for i, _ in sorted(seen)], [y for _, y in sorted(seen)])
    model = corpus_pipeline.toxicity_model(spark, str(tmp_path), docs)
    assert math.isclose(model.bias, want[0], rel_tol=1e-6) and len(model.names) > 20
    for g, w in zip(model.names.tolist(), model.values.tolist(), strict=True):
        assert math.isclose(w, want[1][g], rel_tol=1e-4, abs_tol=1e-6)
    for r in toxicity.score(docs, model).join(docs.dropDuplicates(["doc_id", "text"]).select("doc_id", "text"), "doc_id").where("doc_id < 100").collect():
        assert math.isclose(r["score"], judged(r["text"], want), abs_tol=0.02)
    kept = STAGES["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    scores = toxicity.predict(model, [t for _, t in rows])
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted((r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD), key=str)
    assert not {i for i, _ in rows if i is not None and i % 3 == 0 and i < 48} & {r["doc_id"] for r in kept.collect()}


def shares(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    per = lambda n, of: n / of if of else 0.0
    stops = sum(x.rstrip(".,;:").lower() in quality.STOP_WORDS for x in w)
    return {
        "mean_word_chars": per(sum(map(len, w)), len(w)), "symbols_per_word": per(sum(t.count(c) for c in "#*$%&|<>"), len(w)), "marks_per_word": per(t.count("!") + t.count("?"), len(w)),
        "stop_word_share": per(stops, len(w)), "dup_line_share": per(len(lines) - len(set(lines)), len(lines)),
        "bullet_line_share": per(sum(bool(re.match("[\x20\x09-\x0d]*[-*•●▪‣]", x)) for x in lines), len(lines)), "cut_line_share": per(sum(bool(re.search("(\\.\\.\\.|…)[\x20\x09-\x0d]*\\Z", x)) for x in lines), len(lines)),
    }


def test_quality_stage(spark, docs, documents):
    prose = "\n".join(f"the word{i} of house{i} and tree{i}" for i in range(30))
    more = [(900, prose), (900, prose), (901, prose.replace("\n", "...\n")), (902, prose.replace("and", "!and?")), (903, "x " + prose * 40), (None, prose), (904, prose + "\n- a" * 300)]
    rows = documents + more
    frame = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", len(t), 1, "k") for d, t in more], docs.schema))
    want = []
    for d, t in rows:
        w = WORD.findall(t or "")
        many, covered = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
        for i in range(len(w) - 2):
            covered |= {i, i + 1, i + 2} if many[tuple(w[i : i + 3])] > 1 else set()
        of = shares(t)
        good = len(w) >= 50 and 2 * len(covered) <= len(w)
        if good and all((r.least is None or of[r.measure] >= r.least) and (r.most is None or of[r.measure] <= r.most) for r in quality.RULES):
            want.append((d, t))
    kept = STAGES["quality_rules"](spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted(want, key=str) and 2 < len(want) < len(rows) - 20


def test_near_duplicate_stage(spark, docs, documents):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in documents:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(documents):
        if sets[i]:
            key = (d is None, d or 0)
            best[find(i)] = min(best.get(find(i), (True, math.inf)), key)
    want = sorted([d for _, d in best.values()] + [d for i, (d, _) in enumerate(documents) if not sets[i]], key=str)
    kept = STAGES["ngram_jaccard"](spark, docs, "")
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0 for r in kept.collect()), key=str) == sorted((d or 0 for d in want), key=str)


def test_substring_stage(spark, docs, documents):
    first = {}
    for d, t in documents:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12) if d is not None else ():
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, d), d)
    want = []
    for d, t in documents:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 12) if d is not None else ():
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, left, "en", "s", len(left), 1, "k"))
    got = STAGES["substring_dedup"](spark, docs, "")
    assert got.columns == docs.columns and sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_packing_stage(spark, docs, documents):
    long = documents + [(800, "long words here " * 2500), (800, "long words here " * 2500)]
    frame = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", 1, 1, "k") for d, t in long[-2:]], docs.schema))
    reference = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for d, t in long:
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        want.update((d, s, zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048))
    rows = STAGES["packing"](spark, frame, "").collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows) == want


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, docs, tmp_path, name):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = STAGES[name](spark, docs.limit(0), str(tmp_path))
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_hot_copies(spark):
    """A third of all rows are one text, another third near copies of one; nothing is lost or doubled."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "the same text of ten words or so in every row here") for i in range(400)] + [(1000 + i, base.replace(f"word{i % 60} ", "other ")) for i in range(400)] + [(5000 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(r["doc_id"] for r in STAGES["ngram_jaccard"](spark, frame, "").collect()) == [0, 1000, *range(5000, 5400)]
    cut = {r["doc_id"]: r["text"] for r in STAGES["substring_dedup"](spark, frame.withColumn("n_chars", F.length("text").cast("long")), "").collect()}
    assert len(cut) == 1200 and cut[1000] and all(cut[5000 + i] for i in range(400)) and cut[1060] == ""
