"""Operators 1, 2, 5, 9 and 10 against the tokenizers library and plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphlake.llm import bpe, counts, licenses, packing, quality, tables
from glyphlake.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "1", "é", "ß", "　", "\x1c", "\x85", "...", "<|endoftext|>", "𝔘", "́", "İ", "Σ", "!", "I'LL", "don't", "‍", "\xa0", "\r\n"]


def fuzz(n, seed=1):
    random.seed(seed)
    return ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 60))) for _ in range(n)] + ["a" * 3000, " " * 2000, "x " * 900, "'" * 90]


@pytest.mark.parametrize("mean", [8, 64, 512])
def test_codec(mean):
    reference, codec = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), bpe.ChunkCodec(vocabulary("byte_bpe_50k.json"), mean)
    for text in fuzz(400):
        ids = codec.encode(text)
        want = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == reference.decode(want, skip_special_tokens=False)
    cut = np.array([1, 200, 50256, 160], "<u4")
    assert codec.decode(cut.tobytes()) == reference.decode(cut.tolist(), skip_special_tokens=False)


def test_chunks_are_shared():
    random.seed(2)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    passage = " ".join(words)
    one, two = ({t[a:b] for a, b in zip([0, *bpe.cut_points(t)], bpe.cut_points(t))} for t in ("x " + passage, "quite another start " + passage))
    assert len(one & two) >= len(one) - 2


def test_round_trip(docs, documents):
    reference = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = []
    for d, t in documents:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(docs, vocabulary("byte_bpe_50k.json")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    encoded = bpe.encode(docs, vocabulary("byte_bpe_50k.json"))
    texts = sorted((t or "") for _, t in documents)
    assert sorted(r["text"] for r in bpe.decode(encoded, vocabulary("byte_bpe_50k.json")).collect()) == texts
    assert bpe.round_trip(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_word_encoder():
    reference, encoder = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), packing.WordEncoder(vocabulary("word_bpe_49k.json"), 500)
    texts = fuzz(600, 4)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_id_table():
    rng = np.random.default_rng(1)
    table, want = packing.IdTable(300), {}
    for _ in range(60):
        keys = np.unique(rng.integers(0, 900, 80).astype(np.uint64) * np.uint64(1 << 20))
        new = keys[table.find(keys) < 0]
        ids = {int(k): np.arange(int(k) % 5, dtype="<u4") + int(k) % 1000 for k in new}
        want |= ids
        table.add(new, [ids[int(k)].tobytes() for k in new])
        at = table.find(keys)
        assert (at >= 0).all() and len(table.lengths) <= 300
        for k, e in zip(keys.tolist(), at.tolist(), strict=True):
            assert table.pool[table.starts[e] : table.starts[e] + table.lengths[e]].tolist() == want[k].tolist()


def test_copies():
    rng = np.random.default_rng(2)
    copies, seen = packing.Copies(recent=7), Counter()
    for _ in range(50):
        keys = rng.integers(0, 40, 13).astype(np.uint64)
        for k, n in zip(keys.tolist(), copies.number(keys).tolist(), strict=True):
            assert n == seen[k]
            seen[k] += 1


def test_packing_in_another_order(docs):
    group = lambda df: Counter((r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"] >> 32) for r in packing.pack(df, vocabulary("word_bpe_49k.json"), capacity=64, group_docs=9).collect())
    one = docs.coalesce(1)
    assert group(one.sortWithinPartitions("text")) == group(one.sortWithinPartitions(F.desc("text")))


def test_first_fit_decreasing():
    random.seed(3)
    lengths = [random.randint(1, 100) for _ in range(500)]
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for k in sorted(range(500), key=lambda k: (-lengths[k], k)):
        b = next((i for i, r in enumerate(room) if r >= lengths[k]), len(room))
        room += [100] * (b == len(room))
        want[k] = (b, 100 - room[b])
        room[b] -= lengths[k]
    assert [want[k] for k in range(500)] == list(zip(bins, offsets, strict=True))
    assert packing.first_fit_decreasing([], 10) == ([], []) and packing.first_fit_decreasing([10], 10) == ([0], [0])


def test_packing(docs, documents):
    reference = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for d, t in documents:
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 256):
            want[d, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()), len(ids)] += 1
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=256, group_docs=40).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 256 and sum(filled.values()) >= 0.5 * 256 * len(filled)
    assert packing.pack(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_memory(spark, docs):
    table, rng = packing.IdTable(packing.MEMO_WORDS), np.random.default_rng(2)
    for _ in range(12):
        keys = np.unique(rng.integers(0, 2**63, 150_000).astype(np.uint64))
        table.find(keys)
        table.add(keys, [b"12345678"] * len(keys))
        held = sum(a.nbytes for a in (table._keys, table._slots, table._seen, table.lengths, table.starts, table.pool))
        assert held < 40_000_000
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    packing.pack(docs, vocabulary("word_bpe_49k.json"))
    assert tables.BATCH_BYTES == 4 << 20 == int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))


def test_token_trees():
    reference = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    codec = bpe.ChunkCodec(vocabulary("byte_bpe_50k.json"))
    random.seed(6)
    for text in fuzz(150, 7):
        tree = counts.TokenTree(text, codec, leaf=random.choice([1, 2, 64]))
        for _ in range(4):
            a = random.randint(0, len(text))
            b, put = min(len(text), a + random.choice([0, 1, 9])), "".join(random.choice(ALPHABET) for _ in range(random.choice([0, 1, 30])))
            text = text[:a] + put + text[b:]
            tree.edit(a, b, put)
            assert tree.text == text and tree.tokens == len(reference.encode(text, add_special_tokens=False).ids)
    long = counts.TokenTree("word " * 20000, codec)
    long.edit(50000, 50004, "other")
    assert long.encoded < 30
    with pytest.raises(ValueError):
        long.edit(5, 10**9, "")


def test_kept_trees(spark):
    reference = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    path, rows = vocabulary("byte_bpe_50k.json"), [(1, "word " * 3000), (1, "other words entirely"), (2, None), (None, "x y"), (3, "")]
    kept = counts.trees(spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit(0)), path)
    edits = spark.createDataFrame([(1, 2, 5, "XY"), (1, 10, 10, " new"), (3, 0, 0, "now"), (None, 0, 1, "z")], "doc_id long, start int, end int, put string")
    once = counts.edited(kept, edits, path)
    want = [(d, t[:2] + "XY" + t[5:10] + " new" + t[10:] if d == 1 else "now" if d == 3 else t or "") for d, t in rows]
    assert sorted(((r["doc_id"], r["text"], r["n_tokens"]) for r in once.collect()), key=str) == sorted(((d, t, len(reference.encode(t, add_special_tokens=False).ids)) for d, t in want), key=str)
    assert max(r["n_encoded"] for r in once.collect()) < 40
    again = counts.edited(once, edits.where("doc_id = 3").withColumn("start", F.lit(3)).withColumn("end", F.lit(3)), path)
    assert [r["text"] for r in again.where("doc_id = 3").collect()] == ["nownow"]
    with pytest.raises(Exception, match="overlap"):
        counts.edited(kept, spark.createDataFrame([(1, 0, 5, ""), (1, 3, 6, "")], edits.schema), path).collect()


def test_counts_of_odd_tables(spark):
    path = vocabulary("byte_bpe_50k.json")
    assert counts.count_after_edits(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    odd = spark.createDataFrame([(1, "a@b.example " * 3000, 7), (1, "a@b.example " * 3000, 7), (None, None, 7)], "doc_id long, text string, n_tokens int")
    rows = counts.count_after_edits(odd, path).collect()
    assert len(rows) == 3 and rows[0] == rows[1] and rows[0]["n_edits"] == 3000


def test_counts_after_edits(spark):
    reference = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = [(1, "write to a.b@example.org or +49 170 1234567 now"), (2, None), (None, ""), (4, "no edits here"), (4, "10.0.0.1 and 10.0.0.2")]
    got = sorted((tuple(r) for r in counts.count_after_edits(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).collect()), key=str)
    edited = ["write to <email> or <phone> now", "", "", "no edits here", "<ip> and <ip>"]
    want = sorted(((d, len(reference.encode(t or "").ids), n, len(reference.encode(e).ids)) for (d, t), e, n in zip(rows, edited, [2, 0, 0, 0, 2], strict=True)), key=str)
    assert [(g[0], g[1], g[2], g[4]) for g in got] == want


def test_quality(docs, documents):
    want = []
    for d, t in documents:
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many, covered = Counter(windows), set()
        for i, g in enumerate(windows):
            covered |= {i, i + 1, i + 2} if many[g] > 1 else set()
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    rows = quality.judge(docs).collect()
    assert sorted((tuple(r)[:7] for r in rows), key=str) == sorted(want, key=str)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_rules(spark):
    prose = " ".join(f"the word{i} of house{i}" for i in range(60))
    rows = [(1, prose), (2, prose.replace(" ", "$$$ ")), (3, prose.replace(" ", "!! ")), (4, " ".join(f"w{i}" for i in range(90))), (5, "the same line of text\n" * 30)]
    lines = [f"the word{i} of house{i} and tree{i}" for i in range(40)]
    rows += [(6, "\n".join(f" \u2022 {x}" for x in lines)), (7, "\n".join(f"{x}... \r" if i % 2 else x for i, x in enumerate(lines))), (8, "\n".join(f"- {x}" if i % 2 else f"{x}\u2026" if i % 8 == 0 else x for i, x in enumerate(lines)))]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, False), 4: (False, False), 5: (True, False), 6: (False, False), 7: (False, False), 8: (False, True)}


def test_licenses(docs, documents):
    rows = documents + [(500, "UNDER the MIT-license; under the MIT license 2 CC BY NC"), (501, "the GNU general public license, version 3. İK mit"), (502, "apache license version 2.0 " * 3)]
    rows += [(503, "cc by by nc cc by nc nc by cc " * 40), (504, "mit the license under under the mit license the mit license"), (505, "word " * 30000 + "Licensed under CC BY-SA" + " public license" * 5000)]
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    want = []
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at, base, every, score = [], set(), set(), 0.0
        for x in licenses.TEMPLATES:
            for i in range(len(w) - len(x.key_words) + 1):
                if w[i : i + len(x.key_words)] == x.key_words:
                    every.add(x.label)
                    s = i - x.key_at
                    score = max(score, sum(0 <= s + j < len(w) and w[s + j] == q for j, q in enumerate(x.words)) / len(x.words))
                    if x.base:
                        at.append(i)
                        base.add(x.label)
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(every)), score))
    assert sorted((tuple(r) for r in licenses.scan(frame).collect()), key=str) == sorted(want, key=str)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_texts_are_encoded_together(monkeypatch):
    path, rng = vocabulary("byte_bpe_50k.json"), random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) + "\n7,  8. It's Über <|endoftext|>" for _ in range(60)] + [None, ""]
    reference, codec, calls = Tokenizer.from_file(path), bpe.ChunkCodec(path), []

    class Counting:
        def encode_batch_fast(self, *args, **options):
            calls.append(1)
            return reference.encode_batch_fast(*args, **options)

    codec._tokenizer = Counting()
    monkeypatch.setattr(bpe, "chunk_codec", lambda *_: codec)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = next(bpe._round_trip(path, 512)(iter([batch])))
    want = [np.array(reference.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got.column(2).to_pylist() == [hashlib.sha256(w).hexdigest() for w in want]
    assert len(calls) <= 4  # not once or twice for each chunk


def test_characters_of_every_version():
    reference, codec = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), bpe.ChunkCodec(vocabulary("byte_bpe_50k.json"), 2)
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2" for c in [*range(0xD800), *range(0xE000, 0x10000), 0x1D7CE, 0x1F600, 0x20000]]
    for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.pieces(text) == [text[a:b] for _, (a, b) in reference.pre_tokenizer.pre_tokenize_str(text)], ascii(text)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want.ids, ascii(text)


def test_cuts_of_long_runs():
    reference, codec = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), bpe.ChunkCodec(vocabulary("byte_bpe_50k.json"), 16)
    for text in ("a" * 5000, " \n" * 5000, "#-" * 5000, "1234567890 " * 900, "x" * 3000 + " " + "é" * 3000, "字、" * 2000, "don't'll" * 800):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
