"""Operators 11 to 13 against plain Python, and ids of operator 1."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import audit, infill, jaccard, packing, shards
from glyphlake.llm.queries import vocabulary

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(n=300):
    random.seed(8)
    pieces = ["a", "Bc", " ", "<", ">", "<P", "S>", "<M>", "é", "𝔘", "\n", "7", "P", "PSM", "<S", "\x00", "word "]
    out = ["".join(random.choice(pieces[:16] if i % 3 else pieces[:5] + pieces[8:12]) for _ in range(random.randint(0, 90))) for i in range(n)]
    return out + ["x" * 700, "é" * 700, "<" * 300, "a1" * 400, "𝔘a" * 333, None, "", "<P>", "<", "<S", "<M" * 200 + ">"]


def filled(doc_id, text):
    t = text or ""
    toks = TOKEN.findall(t)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(toks) + 1), h[1] % (len(toks) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (toks[:a], toks[a:b], toks[b:]))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(toks), "plain", None, None, sha(t), sha(t))
    form = "spm" if h[3] % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, len(toks), form, len(prefix), len(middle), sha(output), sha(t))


@pytest.mark.parametrize("giant", [1 << 16, 37, 130])
def test_fill_in_middle(spark, giant):
    rows = [(None if i % 50 == 7 else i // 2, t, 1, "k") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, key string").repartition(3)
    got = [tuple(r) for r in infill.digest(docs, giant).collect()]
    assert sorted(got, key=str) == sorted((filled(d, t) for d, t, *_ in rows), key=str)
    assert len({r[2] for r in got}) == 3
    assert infill.digest(docs.limit(0), giant).count() == 0


def test_scan_from_every_state():
    """A chunk's function and counts are those of a walk over it, and composing halves gives the whole."""
    data = np.frombuffer("".join(t or "" for t in texts(40)).encode(), np.uint8)
    for lane in (1, 3, 64):
        classes, first = infill._lanes(data, np.array([0, len(data)]), lane)
        scan = infill.scan_lanes(classes)
        for state in range(4):
            walked, tokens = state, 0
            for c in infill._CLASS[data]:
                tokens += infill._STARTS[c, walked]
                walked = infill._NEXT[c, walked]
            run = np.zeros(classes.shape[1], np.int64)
            entry = infill.entry_states(scan.last, run, state)
            assert infill.compose(scan.last, run)[-1][state] == walked
            assert scan.tokens[np.arange(len(entry)), entry].sum() == tokens


def audited(rows, labels):
    least, good, toxic = {}, set(), set()
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, q, x in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    facts = []
    for d, t, part in rows:
        words, text = WORD.findall(t or ""), t or ""
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), d is not None and least[text] < d]
        facts.append((part or "", fails, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        first = Counter()
        for order in itertools.permutations("ABCDE"):
            for step in range(1, 6):
                letter = order[step - 1]
                n = defaultdict(int)
                for _, fails, g, x in (f for f in facts if f[0] == part):
                    it, gone = fails["ABCDE".index(letter)], any(fails["ABCDE".index(o)] for o in order[: step - 1])
                    n["kept"] += not gone and not it
                    n["removed"] += not gone and it
                    n["redundant"] += gone and it
                    n["unique"] += it and sum(fails) == 1
                    n["good"] += not gone and it and g
                    n["toxic"] += not gone and it and x
                first[letter] += n["removed"]
                out[part, "".join(order), step] = [n["kept"], n["removed"], n["redundant"], n["unique"], n["good"], n["toxic"], letter]
        for key in [k for k in out if k[0] == part]:
            out[key].append(first[out[key].pop()])
    return out


def test_audit(spark):
    random.seed(4)
    base = [" ".join(random.choice("ab cd ef gh UP it".split()) + random.choice(["", str(random.randrange(150))]) for _ in range(random.choice([3, 250]))) + random.choice(["", "#", "\u00c9\x85"]) for _ in range(12)]
    rows = [(random.choice([None, 1, 2, 3, i]), random.choice([None, "", *base]), random.choice(["en", "de", None, ""])) for i in range(160)] + [(900 + i, base[0], "fr") for i in range(60)]
    labels = [(random.choice([None, i]), random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(200)] + [(1, 0, 1), (1, 1, 0), (1, 1, 0)]
    docs = spark.createDataFrame([(*r, 5, "m") for r in rows], "doc_id long, text string, lang string, mask long, part string").repartition(4)
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in audit.audit(docs, table).collect()}
    want = audited(rows, labels)
    assert len(want) == 4 * 600 and got == want
    assert sum(v[5] for v in want.values()) and sum(v[4] for v in want.values())
    assert audit.audit(docs.limit(0), table).count() == 0
    assert audit.audit(docs, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, tmp_path):
    random.seed(3)
    rows = [(None if i % 40 == 3 else i if i % 3 else 77, random.choice([None, "", "é" * i, "same text"])) for i in range(900)]
    docs = spark.createDataFrame([(d, t, 5, "x", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, shard int, size string, row long").repartition(5)
    got = [tuple(r) for r in shards.digest(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()]
    want = []
    for d, t in rows:
        key, data = int(sha("" if d is None else str(d))[:16], 16), (t or "").encode()
        want.append((d, len(data) + 1, zlib.crc32(data), "key", jump(key, 16), jump(key, 17)))
    order = lambda r: (r[4], r[0] is not None, r[0] or 0, r[2], r[1])
    seen, numbered = Counter(), []
    for r in sorted(want, key=order):
        numbered.append((*r[:5], seen[r[4]], r[5]))
        seen[r[4]] += 1
    assert sorted(got, key=str) == sorted(numbered, key=str)
    assert {r[4] for r in got} == set(range(16)) and {r[6] for r in got if r[4] != r[6]} == {16}
    assert shards.digest(docs.limit(0)).count() == 0
    shards.write(docs, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted((r["row"], str(r["text"])) for r in back) == [(i, str(t)) for i, (_, t) in enumerate(rows)]
    assert sorted((r["shard"], r["slot"]) for r in back) == sorted((r[4], r[5]) for r in numbered)


@pytest.mark.parametrize("n", [1, 2, 50])
def test_jumps(spark, n):
    keys = [random.Random(n).randrange(2**64) for _ in range(200)] + [0, 2**64 - 1]
    found = spark.createDataFrame([(str(k),) for k in keys], "key string").select("key", shards.jumps(F.col("key").cast("decimal(20,0)"), n).alias("at")).collect()
    assert all((r["at"]["shard"], r["at"]["grown_shard"]) == (jump(int(r["key"]), n), jump(int(r["key"]), n + 1)) for r in found)


def test_ids_beside_nulls(spark):
    """A null id in a group leaves large ids as they are, and -1 and null are different documents."""
    big = 2**60
    rows = [(big + 1, "a b c"), (None, "a b c"), (big + 1, "a b c"), (big + 2, None), (-1, "a b c"), (0, "a b c")]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] for r in packed), key=str) == sorted((d for d, _ in rows), key=str)
    assert dict(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json")).dtypes)["doc_id"] == "bigint"


def test_repeats_that_differ_elsewhere(spark):
    """Rows of one id and text: which one stays doesn't depend on their order."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, k) for k in range(20)]
    kept = {jaccard.one_of_each(spark.createDataFrame(rows[:: 1 - 2 * (k % 2)], "doc_id long, text string, k long").repartition(k + 1)).first()["k"] for k in range(3)}
    assert len(kept) == 1
