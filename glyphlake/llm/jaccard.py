"""N-gram Jaccard join (operator 4): a grouped prefix join over sets of word shingles.

Order. The shingles of a set are ordered by hash, with the most frequent ones of the corpus (a bounded list)
last. Sets that are similar enough share a shingle among their first few, the prefix.

Groups. Sets of equal size and prefix form a group, which is indexed as one. A bucket of shingles pairs the
groups that share one: all pairs in a short list; in a long list only pairs with the least group of each
range of sizes, and the list is kept.

Verification. Group pairs are expanded to pairs of distinct sets (copies are one set), filtered by size and
by a parity signature that bounds the overlap from above, and verified on the whole sets. What holds gives
components. Then each long list is looked at again: pairs in one component need nothing more. Of the others, all
are compared with one further member of their list in each of a few turns, which joins what belongs together
by as many pairs as there are members, and in the end all pairs that still lie in different components are
verified. So no link between different texts is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, workers
from .components import components
from .words import Slice, mix, runs, slices

#: Words of a shingle, and the similarity of a link in hundredths.
SHINGLE = 5
PERCENT = 80
#: Frequent shingles that go last in the order; the list is sent to every task. Any list gives right results.
FREQUENT = 65_536
#: Longest list of which all pairs are made.
SHORT_LIST = 8
SIGNATURE_BITS = 1024
#: Sets of so many shingles or more have a second signature of LARGE_BITS, since the first one is full.
LARGE, LARGE_BITS = 1000, 8192
#: Turns in which the rest of long lists is compared with one member each, before all pairs are; and how many
#: pairs for each row are few enough to go to all pairs at once.
STAR_TURNS = 4
FEW_PAIRS = 16
#: Parts that the sets of a list are dealt into.
SALTS = 16
#: Rows (of three integers) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_POSTING = np.dtype([("token", "<u8"), ("group", "<u8"), ("n", "<i4"), ("at", "<i4")])
_MEMBER = np.dtype([("doc", "<i8"), ("key", "<i8"), ("absent", "<i8"), ("n", "<i8"), ("group", "<i8"), ("set", "<i8"), ("signature", "<i8", SIGNATURE_BITS // 64)])
_BITS = np.dtype([("set", "<i8"), ("signature", "<i8", LARGE_BITS // 64)])
_PAIR, _LISTED, _MEMBERS, _LARGE_SIGNATURES = 0, 1, 2, 3


def shingle_sets(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by (text, hash): texts and hashes.

    A text of fewer than k words has its whole sequence as its only shingle.
    """
    hashes = s.hashes()
    grams = runs(hashes, k)
    inside = s.doc[: len(grams)] == s.doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    docs, found = [s.doc[: len(grams)][inside]], [grams[inside]]
    words = np.diff(s.first)
    for n in range(1, k):
        short = np.flatnonzero(words == n)
        if len(short):
            whole = np.full(len(short), n, np.uint64)
            for i in range(n):
                whole = mix(whole * np.uint64(0x2545F4914F6CDD1D) + hashes[s.first[short] + i])
            docs.append(short)
            found.append(whole)
    doc, gram = np.concatenate(docs), np.concatenate(found) >> np.uint64(1)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[fresh], gram[fresh]


def _reorder(doc: np.ndarray, gram: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles get their rank with the highest bit set, and so go last."""
    if len(frequent) and len(gram):
        at = np.minimum(np.searchsorted(frequent, gram), len(frequent) - 1)
        hot = frequent[at] == gram
        if hot.any():
            gram = np.where(hot, np.uint64(1 << 63) | rank[at], gram)
            order = np.lexsort((gram, doc))
            return doc[order], gram[order]
    return doc, gram


def _local_counts(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("jaccard")
        for batch in batches:
            parts = [shingle_sets(s, k)[1] for s in slices(batch.column(0), lower=True)]
            token, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, int))
            many = count >= max(3, batch.num_rows // 1000)
            yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(count[many].astype(np.int64))], ["token", "count"])

    return run


def frequent_shingles(texts: DataFrame, k: int = SHINGLE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` shingles that many texts hold, sorted, and their ranks by frequency.

    Batches report those that repeat within them; only the sums' largest `most` reach the driver. The list only
    orders the shingles; which ones are on it changes the work, not the result.
    """
    counted = texts.select("text").mapInArrow(_local_counts(k), "token long, count long")
    top = counted.groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(most).toArrow()
    token = top.column("token").to_numpy().view(np.uint64)
    rank = np.argsort(np.lexsort((token, top.column("count").to_numpy()))).astype(np.uint64)
    order = np.argsort(token)
    return token[order], rank[order]


def _fold(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each run of values, its length included; first: where runs start."""
    ends = np.append(first[1:], len(values))
    return mix(np.add.reduceat(mix(values + np.uint64(0x632BE59BD9B4E019)), first) + (ends - first).astype(np.uint64))


def _signatures(doc: np.ndarray, gram: np.ndarray, texts: int, bits: int) -> np.ndarray:
    """Parity of the shingles in each of `bits` cells, as 64-bit integers: sets differ in as many shingles as bits at least."""
    cell = doc * bits + (mix(gram) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=texts * bits) & 1).astype(np.uint8).reshape(texts, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def _index(k: int, percent: int, buckets: int, frequent: np.ndarray, rank: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("jaccard")
        for batch in batches:
            nulls = np.array(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            postings, members, large = [], [], []
            for s in slices(batch.column(2), lower=True):
                doc, gram = _reorder(*shingle_sets(s, k), frequent, rank)
                n = np.bincount(doc, minlength=s.hi - s.lo)
                start = np.cumsum(n) - n
                full = np.flatnonzero(n)
                member = np.zeros(s.hi - s.lo, _MEMBER)
                member["doc"], member["key"], member["absent"], member["n"] = ids[s.lo : s.hi], keys[s.lo : s.hi], nulls[s.lo : s.hi], n
                if len(full):
                    prefix = n - -(-percent * n // 100) + 1
                    at = np.arange(len(doc)) - start[doc]
                    head = at < prefix[doc]
                    hdoc, hgram, hat = doc[head], gram[head], at[head]
                    group = _fold(hgram, np.flatnonzero(hat == 0)) + n[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    member["group"][full] = mix(group).view(np.int64)
                    member["set"][full] = _fold(gram, start[full]).view(np.int64)
                    member["signature"] = _signatures(doc, gram, s.hi - s.lo, SIGNATURE_BITS)
                    for i in np.flatnonzero(n >= LARGE):
                        more = np.zeros(1, _BITS)
                        own = gram[start[i] : start[i] + n[i]]
                        more["set"], more["signature"] = member["set"][i], _signatures(np.zeros(len(own), np.int64), own, 1, LARGE_BITS)
                        large.append(more)
                    _, once = np.unique(member["group"][full], return_index=True)
                    chosen = np.zeros(s.hi - s.lo, bool)
                    chosen[full[once]] = True
                    take = chosen[hdoc]
                    posting = np.zeros(int(take.sum()), _POSTING)
                    posting["token"], posting["at"] = hgram[take], hat[take]
                    posting["group"], posting["n"] = member["group"][hdoc[take]].view(np.uint64), n[hdoc[take]]
                    postings.append(posting)
                members.append(member)
            if not members:
                continue
            rows = [(int(members[0]["key"][0] % buckets), _MEMBERS, np.concatenate(members).tobytes())]
            if large:
                rows.append((rows[0][0], _LARGE_SIGNATURES, np.concatenate(large).tobytes()))
            if postings:
                p = np.concatenate(postings)
                bucket = (mix(p["token"]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                p, bucket = p[order], bucket[order]
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
                rows += [(int(bucket[i]), _PAIR, p[i:j].tobytes()) for i, j in zip(cuts, [*cuts[1:], len(p)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["bucket", "kind", "rows"])

    return run


def _compatible(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether postings of one shingle, x not larger than y, can be of sets similar enough."""
    nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
    need = -(-percent * (nx + ny) // (100 + percent))
    rest = np.minimum(nx - x["at"], ny - y["at"]) + np.minimum(x["at"], y["at"])
    return (100 * nx >= percent * ny) & (x["at"] < nx - -(-2 * percent * nx // (100 + percent)) + 1) & (rest >= need)


def _pair_up(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in rows.loc[rows["kind"] == _MEMBERS, "rows"]:
            m = np.frombuffer(blob, _MEMBER)
            out.append(pd.DataFrame({"kind": _MEMBERS, "a": m["group"], "b": m["set"], "n": m["n"], "at": m["doc"], "key": m["key"], "absent": m["absent"], "signature": list(m["signature"])}))
        for blob in rows.loc[rows["kind"] == _LARGE_SIGNATURES, "rows"]:
            m = np.frombuffer(blob, _BITS)
            out.append(pd.DataFrame({"kind": _LARGE_SIGNATURES, "a": m["set"], "b": 0, "n": 0, "at": 0, "key": 0, "absent": 0, "signature": list(m["signature"])}))
        blobs = rows.loc[rows["kind"] == _PAIR, "rows"]
        if len(blobs):
            p = np.concatenate([np.frombuffer(b, _POSTING) for b in blobs])
            p = p[np.lexsort((p["group"], p["n"], p["token"]))]
            same = p["token"][1:] == p["token"][:-1]
            p = p[np.append(True, ~(same & (p["group"][1:] == p["group"][:-1])))]
            start = np.flatnonzero(np.append(True, p["token"][1:] != p["token"][:-1]))
            length = np.diff(np.append(start, len(p)))
            left, right = [], []
            for m in range(2, SHORT_LIST + 1):
                lists = start[length == m]
                for i in range(m) if len(lists) else ():
                    for j in range(i + 1, m):
                        ok = _compatible(p[lists + i], p[lists + j], percent)
                        left.append(p["group"][lists[ok] + i])
                        right.append(p["group"][lists[ok] + j])
            for s, m in zip(start[length > SHORT_LIST].tolist(), length[length > SHORT_LIST].tolist(), strict=True):
                members, at = p[s : s + m], 0
                out.append(pd.DataFrame({"kind": _LISTED, "a": members["token"].view(np.int64), "b": members["group"].view(np.int64), "n": members["n"].astype(np.int64), "at": members["at"].astype(np.int64), "key": 0, "absent": 0, "signature": None}))
                while at < m:  # a range of sizes and its least group
                    end = int(np.searchsorted(members["n"], members["n"][at] * 100 // percent, side="right"))
                    left.append(np.full(end - at - 1, members["group"][at]))
                    right.append(members["group"][at + 1 : end])
                    at = end
            if left:
                a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                out.append(pd.DataFrame({"kind": _PAIR, "a": pairs[:, 0], "b": pairs[:, 1], "n": 0, "at": 0, "key": 0, "absent": 0, "signature": None}))
        names = ["kind", "a", "b", "n", "at", "key", "absent", "signature"]
        frame = pd.concat([o for o in out if len(o)])[names] if any(map(len, out)) else pd.DataFrame({c: [] for c in names})
        frame["signature"] = frame["signature"].astype(object)  # all null: Arrow would see numbers
        return frame

    return run


def _load_sets(k: int) -> Callable:
    """The sets of texts as 6-byte hashes in order, and their parity signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("jaccard")
        for batch in batches:
            blobs = []
            for s in slices(batch.column(1), lower=True):
                doc, gram = shingle_sets(s, k)
                low = np.ascontiguousarray(gram & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]
                cuts = np.searchsorted(doc, np.arange(s.hi - s.lo + 1))
                blobs += [low[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["set", "shingles"])

    return run


def _verify(percent: int) -> Callable:
    def unpack(blob: bytes) -> np.ndarray:
        wide = np.zeros((len(blob) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
        return wide.reshape(-1).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("jaccard")
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                both = np.concatenate([unpack(x), unpack(y)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked[i] = (100 + percent) * shared >= percent * len(both)
            kept = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["x", "y"])

    return run


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bucket_chars: int = tables.BUCKET_CHARS) -> tuple[DataFrame, list[DataFrame]]:
    """Row for row of docs (doc_id, text): doc_id, text_key, n_shingles, set (equal sets: equal) and root (equal: one component).

    Texts are folded A-Z to a-z; words are runs of bytes other than space and U+0009-U+000D; two texts link
    if 100 * intersection >= percent * union of their shingle sets. Null and empty texts have no shingle and
    no link (set and root null). Rows with null or equal ids are rows like others; an empty table gives no
    rows; further columns are ignored. With the rows come the written tables that they are read from.
    """
    spark = docs.sparkSession
    tables.bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    frequent, rank = frequent_shingles(texts, shingle)
    buckets = tables.buckets(docs, bucket_chars)
    indexed = texts.mapInArrow(_index(shingle, percent, buckets, frequent, rank), "bucket long, kind int, rows binary")
    schema = "kind int, a long, b long, n long, at long, key long, absent long, signature array<long>"
    found = tables.written(spark, indexed.groupBy("bucket").applyInPandas(_pair_up(percent), schema))
    tables.release(spark)
    members = found.where(F.col("kind") == _MEMBERS).select(
        F.expr("if(absent = 1, null, at)").alias("doc_id"), F.col("key").alias("text_key"), "n", F.expr("if(n = 0, null, a)").alias("group"), F.expr("if(n = 0, null, b)").alias("set"), "signature"
    )
    # one text for each set; groups of copies meet here as one row
    sets = members.where("n > 0").groupBy("set").agg(F.first("group").alias("group"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.min(F.struct("text_key", "doc_id")).alias("of"))
    large = found.where(F.col("kind") == _LARGE_SIGNATURES).groupBy(F.col("a").alias("set")).agg(F.first("signature").alias("more"))
    sets = sets.join(large, "set", "left")
    sets = tables.written(spark, sets.select("set", "group", "n", "signature", "more", F.col("of.text_key").alias("text_key"), F.col("of.doc_id").alias("doc_id")))

    side = lambda name: sets.select(F.col("group").alias(f"g{name}"), F.col("set").alias(name), F.col("n").alias(f"n{name}"))
    close = lambda: 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    pairs = found.where(F.col("kind") == _PAIR).select(F.col("a").alias("gx"), F.col("b").alias("gy")).distinct()
    across = pairs.join(side("x"), "gx").join(side("y"), "gy").where(close()).select("x", "y", "nx", "ny")
    # sets of one group: each with the least
    least = sets.groupBy("group").agg(F.min("set").alias("x"), F.count("set").alias("many")).where("many > 1")
    within = sets.join(least, "group").where("set != x").select("x", F.col("set").alias("y"), F.col("n").alias("nx"), F.col("n").alias("ny"))
    candidates = across.unionByName(within)
    once = candidates.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "nx", "ny").where("x != y").dropDuplicates(["x", "y"])
    sign = lambda n: sets.select(F.col("set").alias(n), F.col("n").alias(f"n{n}"), F.col("signature").alias(f"s{n}"), F.col("more").alias(f"m{n}"))
    near = lambda pairs: pairs.join(sign("x"), "x").join(sign("y"), "y").where(close() & _near(percent)).select("x", "y")
    edges, n_edges = _verified(spark, near(once.select("x", "y")), sets, texts, shingle, percent)[:2]
    tables.release(spark)
    roots = components(spark, edges, n_edges)
    tables.drop(edges)

    # long lists, and groups as lists: pairs of different components have still to be verified
    listed = found.where(F.col("kind") == _LISTED).select(F.col("a").alias("list"), F.col("b").alias("group"), "at")
    lists = listed.join(sets.select("group", "set", "n"), "group").select("list", "set", "n", "at")
    many = sets.join(least.select("group"), "group").select(F.col("group").alias("list"), "set", "n", F.lit(0).cast("long").alias("at"))
    rest, before = lists.unionByName(many), None
    finish = False
    for turn in range(STAR_TURNS + 1):
        rooted = rest.drop("root").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
        mixed = rooted.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("list")
        # a list may hold many sets: they are dealt by a second key too, which every list of mixed gets
        dealt = rooted.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int"))
        every = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rest = tables.written(spark, dealt.join(every, ["list", "salt"]).select("list", "set", "n", "at", "root"))
        if before is not None:
            tables.drop(before)
        before = rest
        sizes = rest.groupBy("list").agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("pairs")).first()
        if not sizes["rows"]:
            break
        last = finish or turn == STAR_TURNS or sizes["pairs"] <= FEW_PAIRS * sizes["rows"]
        # ranges of sizes, whose bounds move from turn to turn
        band = F.floor(F.log("n") / float(np.log(100 / percent)) + turn * 0.37)
        if last:  # all pairs
            signed = rest.join(sets.select("set", "signature", "more"), "set")
            side_of = lambda n: signed.select(F.col("list").alias(f"list{n}"), F.col("set").alias(n), F.col("signature").alias(f"s{n}"), F.col("more").alias(f"m{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("n", "at", "root")])  # noqa: E731,B023
            room = F.least(F.expr("nx - atx"), F.expr("ny - aty")) + F.least("atx", "aty")
            pairs = side_of("x").join(side_of("y"), F.expr("listx = listy and x < y and rootx != rooty") & close() & (room >= _least_overlap(percent)) & _near(percent)).select("x", "y").distinct()
        else:  # each with one member of its list and range of sizes, another one in each list and turn
            chosen = rest.groupBy("list", band.alias("band")).agg(F.min(F.struct(F.xxhash64("set", "list", F.lit(turn)).alias("h"), "set", "root")).alias("c"))
            leader = chosen.select("list", "band", F.col("c.set").alias("x"), F.col("c.root").alias("rootx"))
            both = rest.withColumn("band", band).join(leader, ["list", "band"]).where("root != rootx")
            pairs = near(both.select(F.least("x", "set").alias("x"), F.greatest("x", "set").alias("y")).distinct())
        fresh, n_fresh, n_pairs = _verified(spark, pairs, sets, texts, shingle, percent)
        tables.release(spark)
        finish = 4 * n_fresh < n_pairs  # further stars would join little
        if n_fresh:
            roots = _joined_up(spark, roots, fresh, n_fresh)
        tables.drop(fresh)
        if last:
            break
    tables.drop(rest, sets)
    rooted = members.join(roots.withColumnRenamed("node", "set"), "set", "left")
    return rooted.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "set", F.coalesce("root", "set").alias("root")), [found]


def _joined_up(spark, roots: DataFrame, fresh: DataFrame, n_fresh: int) -> DataFrame:
    """roots (node, root) after the fresh links (x, y): components of the links between roots, and what hung on these."""
    end = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    lifted = fresh.join(end("x"), "x", "left").join(end("y"), "y", "left")
    links = tables.written(spark, lifted.select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y")).distinct())
    more = components(spark, links, n_fresh)
    tables.drop(links)
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return tables.written(spark, moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(more))


def _least_overlap(percent: int):
    return F.ceil(F.lit(percent) * (F.col("nx") + F.col("ny")) / F.lit(100 + percent))


def _near(percent: int):
    """Whether signatures sx and sy leave room for a link: sets of a pair may differ in nx + ny - 2 * (least overlap) shingles."""
    bits = F.lit(0)
    for i in range(SIGNATURE_BITS // 64):
        bits = bits + F.bit_count(F.get("sx", F.lit(i)).bitwiseXOR(F.get("sy", F.lit(i))))
    room = F.col("nx") + F.col("ny") - 2 * _least_overlap(percent)
    more = F.aggregate(F.zip_with("mx", "my", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, x: t + x)
    return (bits <= room) & (F.col("mx").isNull() | F.col("my").isNull() | (more <= room))


def _verified(spark, near: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, int, int]:
    """The pairs (x, y) of near whose sets are similar enough, how many they are, and how many near has.

    Only the sets of these pairs are made from their texts.
    """
    near = tables.written(spark, near)
    n_pairs = near.count()
    if not n_pairs:
        return near, 0, 0
    wanted = near.select(F.explode(F.array("x", "y")).alias("set")).distinct()
    low = F.lit(-(2**63)).cast("long")
    of = tables.written(spark, sets.join(wanted, "set").select("set", "text_key", F.coalesce("doc_id", low).alias("_d")))
    few = 2 * n_pairs <= BROADCAST_ROWS or of.count() <= BROADCAST_ROWS
    hit = texts.withColumn("_d", F.coalesce("doc_id", low)).join(F.broadcast(of) if few else of, ["text_key", "_d"])
    loaded = hit.select("set", "text").mapInArrow(_load_sets(shingle), "set long, shingles binary")
    # a row that is repeated gives its set again
    loaded = tables.written(spark, loaded.groupBy("set").agg(F.min("shingles").alias("shingles")))
    side = lambda n: loaded.select(F.col("set").alias(n), F.col("shingles").alias(f"s{n}"))
    both = near.join(side("x"), "x").join(side("y"), "y").select("x", "y", "sx", "sy")
    kept = tables.written(spark, both.mapInArrow(_verify(percent), "x long, y long"))
    tables.drop(near, of, loaded)
    return kept, kept.count(), n_pairs


def _classes_of(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows of `join`, written."""
    rows, sources = join(docs, shingle, percent)
    rows = tables.written(docs.sparkSession, rows)
    tables.drop(*sources)
    return rows


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id of the row's component, for each row; see `join`."""
    rows = _classes_of(docs, shingle, percent)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest (doc_id, text_key), null ids last. Rows without shingles stay.

    docs keeps its own columns, whatever their names; what repeats the chosen id and text is one row too, that
    of the smallest hash if they differ in further columns.
    """
    rows = _classes_of(docs, shingle, percent)
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("of"))
    chosen = first.select(F.col("of.doc_id").alias("d"), F.col("of.text_key").alias("k"), F.lit(True).alias("first")).distinct()
    bare = rows.where("root is null").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct().withColumn("first", F.lit(False))
    keyed = docs.select(tables.row_of(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    kept = keyed.join(chosen.unionByName(bare), F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    # repeated rows of the chosen id and text are one too
    repeated = kept.where("first").groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.where(~F.col("first")).select("row").unionByName(repeated.select("row")).select("row.*")
