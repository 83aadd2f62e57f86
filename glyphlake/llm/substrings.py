"""Substring dedup (operator 3): seed and extend over winnowed anchors.

Every run of `window` words has one anchor: of the `anchor`-word runs inside it the one with the least hash,
the first of equals. Runs with equal words have equal anchors, so a repeat across documents always shares
its anchors, and there are far fewer anchors than runs.

Seeds. Each task finds the anchors of its documents. An occurrence carries the anchor's hash and a hash of its
context, which is all runs that it is the anchor of. Within a task an occurrence whose context an
earlier document has is settled at once (all its runs repeat); the others go to the bucket of the anchor.
A bucket settles contexts the same way across tasks and drops anchors of a single document, which most are.

Extension. What stays are the first occurrences of contexts that share their anchor with another context:
the places where a repeat starts or ends. Only for those are runs compared one by one, to both sides of
the anchor, and the maximal repeats are the unions of the runs found.

A bucket holds no text, only 28 bytes an occurrence, in numbers that follow the input. An anchor with more
contexts in one task than HOT_CONTEXTS skips the bucket: a marker tells the bucket, and all its runs are
compared in a Spark aggregate, which combines before it shuffles, and a join that splits hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import tables, workers
from .words import mix, runs, slices

#: A repeat has at least so many words.
WINDOW = 13
ANCHOR = 5
HOT_CONTEXTS = 64

_SETTLED, _OPEN = 0, 1
_SEED = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<i4"), ("n", "<i4")])
_RUNS = "kind int, doc_id long, text_key long, at int, n int"


def anchors(hashes: np.ndarray, doc: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, hash of the context, first run and number of runs of each anchor occurrence.

    hashes and doc are of words; runs are named by their first word and don't cross documents.
    """
    n = len(hashes) - window + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= 0:
        return none
    grams = runs(hashes, anchor)
    least, where = grams[:n].copy(), np.zeros(n, np.int8)
    for i in range(1, window - anchor + 1):
        better = grams[i : i + n] < least
        np.copyto(least, grams[i : i + n], where=better)
        where[better] = i
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(at):
        return none
    place, offset = at + where[at], where[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(fresh)
    whole = runs(hashes, window)[at]
    context = np.add.reduceat(mix(whole + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    return least[at[first]], mix(context), at[first], np.diff(np.append(first, len(at)))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in sorted keys."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return fresh


def _firsts(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """seeds sorted by (anchor, context, doc), and whether each is of the least document of its context."""
    seeds = seeds[np.lexsort((seeds["doc"], seeds["context"], seeds["anchor"]))]
    fresh = _groups(seeds["anchor"], seeds["context"])
    least = seeds["doc"][fresh][np.cumsum(fresh) - 1]
    return seeds, seeds["doc"] == least


def _seeds(window: int, anchor: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("substrings")
        for batch in batches:
            workers.release()
            ids, keys, parts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), []
            for s in slices(batch.column(2)):
                a, c, at, n = anchors(s.hashes(), s.doc, window, anchor)
                part = np.zeros(len(a), _SEED)
                doc = s.doc[at] if len(at) else at
                part["anchor"], part["context"], part["at"], part["n"] = a, c, at - s.first[doc], n
                part["doc"], part["key"] = ids[s.lo + doc], keys[s.lo + doc]
                parts.append(part)
            if not parts:
                continue
            seeds, first = _firsts(np.concatenate(parts))
            settled, seeds = seeds[~first], seeds[first]
            new_anchor, new_context = _groups(seeds["anchor"]), _groups(seeds["anchor"], seeds["context"])
            group = np.cumsum(new_anchor) - 1
            contexts = np.bincount(group[new_context], minlength=group[-1] + 1 if len(group) else 0)
            hot = contexts[group] > HOT_CONTEXTS
            marks = seeds[hot & new_anchor].copy()
            marks["n"] = 0
            opened, rest = seeds[hot], np.concatenate([seeds[~hot], marks])
            bucket = (rest["anchor"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rest, bucket = rest[order], bucket[order]
            cuts = np.flatnonzero(_groups(bucket)).tolist() if len(bucket) else []
            rows = [(int(bucket[i]), 2, rest[i:j].tobytes()) for i, j in zip(cuts, [*cuts[1:], len(rest)], strict=True)]
            spread = int(ids[0]) % buckets if len(ids) else 0
            rows += [(spread, kind, part.tobytes()) for kind, part in ((_SETTLED, settled), (_OPEN, opened)) if len(part)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["bucket", "kind", "seeds"])

    return run


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket of seeds: runs that repeat, and runs that have to be compared."""
    out = []
    for kind in (_SETTLED, _OPEN):
        out += [(kind, np.frombuffer(b, _SEED)) for b in rows.loc[rows["kind"] == kind, "seeds"]]
    blobs = rows.loc[rows["kind"] == 2, "seeds"]
    if len(blobs):
        seeds = np.concatenate([np.frombuffer(b, _SEED) for b in blobs])
        hot = np.unique(seeds["anchor"][seeds["n"] == 0])
        seeds, first = _firsts(seeds[seeds["n"] > 0])
        out.append((_SETTLED, seeds[~first]))
        seeds = seeds[first]
        if len(seeds):
            new = _groups(seeds["anchor"])
            group = np.cumsum(new) - 1
            many = np.bincount(group[_groups(seeds["anchor"], seeds["context"])]) > 1
            low, high = np.minimum.reduceat(seeds["doc"], np.flatnonzero(new)), np.maximum.reduceat(seeds["doc"], np.flatnonzero(new))
            wanted = (many & (low < high))[group] | np.isin(seeds["anchor"], hot)
            out.append((_OPEN, seeds[wanted]))
    kinds = np.concatenate([np.full(len(s), k, np.int32) for k, s in out]) if out else np.zeros(0, np.int32)
    seeds = np.concatenate([s for _, s in out]) if out else np.zeros(0, _SEED)
    return pd.DataFrame({"kind": kinds, "doc_id": seeds["doc"], "text_key": seeds["key"], "at": seeds["at"], "n": seeds["n"]})


def _compare(window: int) -> Callable:
    """Hashes of the open runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("substrings")
        for batch in batches:
            workers.release()
            open_runs = batch.column(3)
            starts = open_runs.flatten().field("at").to_numpy(zero_copy_only=False).astype(np.int64)
            counts = open_runs.flatten().field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(open_runs)), np.diff(open_runs.offsets.to_numpy()))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in slices(batch.column(2)):
                mine = (owner >= s.lo) & (owner < s.hi)
                at, n, own = starts[mine], counts[mine], owner[mine]
                each = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = np.repeat(own, n)
                whole = runs(s.hashes(), window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(whole[s.first[own - s.lo] + each].view(np.int64), pa.int64()),
                        pa.array(ids[own], pa.int64()),
                        pa.array(keys[own], pa.int64()),
                        pa.array(each.astype(np.int32), pa.int32()),
                    ],
                    ["run", "doc_id", "text_key", "at"],
                )

    return run


def _cut(window: int) -> Callable:
    """Removes the words that repeated runs cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("substrings")
        for batch in batches:
            workers.release()
            texts, found = batch.column(0), batch.column(1)
            flat, offsets = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
            starts = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
            counts = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            for s in slices(texts):
                n_words, n_removed, kept = [], [], []
                for i in range(s.hi - s.lo):
                    lo, hi = int(s.first[i]), int(s.first[i + 1])
                    covered = np.zeros(hi - lo + 1, np.int32)
                    a, b = offsets[s.lo + i], offsets[s.lo + i + 1]
                    if a < b:
                        np.add.at(covered, starts[a:b], 1)
                        np.add.at(covered, starts[a:b] + counts[a:b] + window - 1, -1)
                        np.cumsum(covered, out=covered)
                    left = np.flatnonzero(covered[:-1] == 0) + lo
                    data = s.data[s.offsets[i] : s.offsets[i + 1]].tobytes()
                    base = s.offsets[i]
                    if len(left) == hi - lo:
                        kept.append(b" ".join(data.split()))  # bytes.split() has the same white space
                    else:
                        kept.append(b" ".join([data[p:q] for p, q in zip((s.starts[left] - base).tolist(), (s.ends[left] - base).tolist(), strict=True)]))
                    n_words.append(hi - lo)
                    n_removed.append(hi - lo - len(left))
                columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                passed = batch.slice(s.lo, s.hi - s.lo).columns[2:]
                yield pa.RecordBatch.from_arrays([*passed, *columns], [*batch.schema.names[2:], "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bucket_chars: int = tables.BUCKET_CHARS, carried: list[str] | None = None) -> DataFrame:
    """row (the columns of docs in `carried`, or all, whatever their names), n_words, n_removed and kept for each row of docs (doc_id, text, ...).

    Words are runs of bytes other than space and U+0009-U+000D. A word is removed if it stands in a run of
    `window` words that also starts in a row with a smaller doc_id; what is left is joined by one space.
    Runs are judged on the input, never on what is left. Rows of one doc_id don't count against each other,
    so repeated rows come out equal; a null doc_id is neither smaller nor larger than any, so such rows stay
    whole; null and empty texts have no words; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tables.bounded_bytes(spark)
    buckets = tables.buckets(docs, bucket_chars)
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")
    )
    seeds = texts.mapInArrow(_seeds(window, anchor, buckets), "bucket long, kind int, seeds binary")
    settled = tables.written(spark, seeds.groupBy("bucket").applyInPandas(_settle, _RUNS))
    tables.release(spark)
    as_runs = F.collect_set(F.struct("at", "n")).alias("runs")
    open_runs = settled.where(F.col("kind") == _OPEN).groupBy("doc_id", "text_key").agg(as_runs)
    # rows of one doc_id and text are one here: their runs are the same
    compared = tables.written(
        spark,
        texts.join(open_runs, ["doc_id", "text_key"])
        .select("doc_id", "text_key", "text", "runs")
        .mapInArrow(_compare(window), "run long, doc_id long, text_key long, at int"),
    )
    tables.release(spark)
    least = compared.groupBy("run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    later = compared.join(least.select("run", "least"), "run").where("doc_id > least").select("doc_id", "text_key", "at", F.lit(1).alias("n"))
    # settled and compared are read by the result
    repeated = settled.where(F.col("kind") == _SETTLED).select("doc_id", "text_key", "at", "n").unionByName(later)
    by_text = repeated.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(as_runs)
    columns = docs if carried is None else docs.select(*[F.col(f"`{c.replace('`', '``')}`") for c in carried])
    whole = docs.select(tables.row_of(columns), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    nothing = F.array().cast("array<struct<at:int,n:int>>")
    rows = whole.join(by_text, (F.col("id") == F.col("d")) & (F.col("key") == F.col("k")), "left").select("text", F.coalesce("runs", nothing).alias("runs"), "row")
    return rows.mapInArrow(_cut(window), StructType([rows.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]))


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row; rows as `remove_repeats` has them."""
    cut = remove_repeats(docs.select("doc_id", "text"), window, carried=["doc_id"])
    return cut.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def apply(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut out of text (null texts become empty), and n_chars, if any, counted anew."""
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    cut = remove_repeats(docs, window, carried=[c for c in docs.columns if c not in new])  # the text itself goes once
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c.replace('`', '``')}`").alias(c) for c in docs.columns])
