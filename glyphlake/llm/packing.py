"""Packing of tokenised documents into sequences (operator 1).

Documents are tokenised where they lie and cut every `capacity` ids; only (length, checksum) records are
shuffled. Full pieces are sequences of their own. The rest is packed by first-fit decreasing, which a
tournament tree of bin capacities answers in O(log bins), independently in randomised groups of documents.
A document's group is a hash of its id, its ids, its number among equal rows of the task, and the task: a task
that runs again, over the same rows in another order, sends the same rows to each group.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, workers
from .words import mix, slices

CAPACITY = 2048
END_ID = 1
#: Documents in a group on average; a group is packed by one task.
GROUP_DOCS = 4096
#: Distinct words whose ids a Python worker keeps, about 50 bytes each and twice that while the table grows.
MEMO_WORDS = 500_000
#: Distinct words without marks and capitals that are kept besides, as Python objects of some 200 bytes.
MEMO_CORES = 60_000

#: Words of letters that no Unicode normal form changes, perhaps with marks behind: one pre-token or two.
_PLAIN = re.compile("([a-zA-ZßÀ-ÖØ-Þà-öø-ÿ]+)([.,!?%&*$#;:]*)").fullmatch
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group long"


class Lately:
    """A dictionary of what was asked for lately: when the new half is full, it takes the place of the old one."""

    def __init__(self, limit: int):
        self.new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._half = limit // 2

    def missing(self, keys: set[str]) -> list[str]:
        """Those of keys that have still to be learned; the others are in `new` from now on."""
        if len(self.new) + len(keys) > self._half:
            self._old, self.new = self.new, {}
        out = []
        for key in keys:  # a difference of sets would go through all of `new`
            if key in self.new:
                continue
            if (value := self._old.get(key)) is None:
                out.append(key)
            else:
                self.new[key] = value
        return out


class IdTable:
    """Ids of words by the words' 64-bit hashes, in NumPy arrays: an open hash table of entries, and a pool of ids."""

    def __init__(self, limit: int):
        self._limit = limit
        self._fill(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, "<u4"))
        self._turn = 0

    def _fill(self, keys: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> None:
        size = 1 << max(10, int(2 * max(len(keys), 1)).bit_length())
        self._slots, self._mask = np.full(size, -1, np.int32), np.uint64(size - 1)
        self._keys, self.lengths, self.pool = keys, lengths, pool
        self.starts = np.cumsum(lengths) - lengths
        self._seen = np.zeros(len(keys), np.int64)
        self._place(np.arange(len(keys), dtype=np.int32))

    def _place(self, entries: np.ndarray) -> None:
        slot = (self._keys[entries] & self._mask).astype(np.int64)
        while len(entries):
            free = np.flatnonzero(self._slots[slot] < 0)
            self._slots[slot[free]] = entries[free]  # of entries with one slot the last stays
            left = self._slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & int(self._mask)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 without one."""
        self._turn += 1
        slot = (keys & self._mask).astype(np.int64)
        out = self._slots[slot]
        open_ = np.flatnonzero(out >= 0)
        open_ = open_[self._keys[out[open_]] != keys[open_]]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self._mask)
            out[open_] = self._slots[slot[open_]]
            open_ = open_[out[open_] >= 0]
            open_ = open_[self._keys[out[open_]] != keys[open_]]
        self._seen[out[out >= 0]] = self._turn
        return out

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """New distinct keys. A full table first drops the half that wasn't asked for the longest."""
        if len(self._keys) + len(keys) > self._limit and len(self._keys):
            kept = np.sort(np.argsort(-self._seen, kind="stable")[: max(self._limit // 2, int((self._seen == self._turn).sum()))])
            seen, sizes = self._seen[kept], self.lengths[kept]
            at = np.repeat(self.starts[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            self._fill(self._keys[kept], sizes, self.pool[at])
            self._seen[:] = seen
        lengths = np.array([len(i) // 4 for i in ids], np.int64)
        n = len(self._keys)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        self._keys, self.lengths = np.concatenate([self._keys, keys]), np.concatenate([self.lengths, lengths])
        self._seen = np.concatenate([self._seen, np.full(len(keys), self._turn, np.int64)])
        if 2 * len(self._keys) > len(self._slots):
            seen = self._seen
            self._fill(self._keys, self.lengths, self.pool)
            self._seen[:] = seen
        else:
            self._place(np.arange(n, len(self._keys), dtype=np.int32))


class WordEncoder:
    """Ids of whole texts for a tokenizer that never joins text across white space, with the ids of words kept.

    Words are runs of bytes other than space and U+0009-U+000D; other white space stays inside a word, which
    the tokenizer then splits itself. Words not met before are encoded together: plain Latin words, without
    the marks behind them, as one text without the steps that can't change them (normal form, split pattern),
    cut again after the ids that end a word; the others as a batch.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, memo_cores: int = MEMO_CORES, word_end: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer, self._bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self._tokenizer, self._bare):
            t.no_padding()
            t.no_truncation()
        self._bare.normalizer = normalizers.Sequence([])
        self._bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._words, self._cores = IdTable(memo_words), Lately(memo_cores)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(word_end)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        split = [(m[1].lower(), m[2]) if (m := _PLAIN(w)) else None for w in words]
        new = self._cores.missing({part for both in split if both for part in both if part})
        cores = self._cores.new
        cores[""] = b""
        if new:
            ids = np.array(self._bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            if len(ends) == len(new):
                data = ids.tobytes()
                cores.update((w, data[a:b]) for w, a, b in zip(new, [0, *ends[:-1]], ends, strict=True))
            else:  # not a vocabulary of that kind
                split = [None] * len(words)
        other = iter(self._encode([w for w, both in zip(words, split, strict=True) if not both]))
        return [cores[both[0]] + cores[both[1]] if both else next(other) for both in split]

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text (null: empty)."""
        table = self._words
        for s in slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            keys = s.hashes()
            entry = table.find(keys)
            unknown = np.flatnonzero(entry < 0)
            if len(unknown):
                fresh, first = np.unique(keys[unknown], return_index=True)
                data = s.data.tobytes()
                at = unknown[first]
                table.add(fresh, self._learn([data[a:b].decode() for a, b in zip(s.starts[at].tolist(), s.ends[at].tolist(), strict=True)]))
                entry = table.find(keys)
            sizes = table.lengths[entry]
            stops = np.append(0, np.cumsum(sizes))
            ids = table.pool[np.repeat(table.starts[entry] - stops[:-1], sizes) + np.arange(stops[-1])].tobytes()
            cuts = (4 * stops[s.first]).tolist()
            yield from (ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


class Copies:
    """Counts equal keys: the n-th row of a key gets n, whatever rows stand between. 16 bytes a key."""

    def __init__(self, recent: int = 1 << 16):
        self._keys, self._counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._recent: dict[int, int] = {}
        self._limit = recent

    def number(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._keys, keys), max(0, len(self._keys) - 1))
        base = np.where(self._keys[at] == keys, self._counts[at], 0) if len(self._keys) else np.zeros(len(keys), np.int64)
        out, recent = np.zeros(len(keys), np.int64), self._recent
        for i, (key, n) in enumerate(zip(keys.tolist(), base.tolist(), strict=True)):
            out[i] = n = recent.get(key, n)
            recent[key] = n + 1
        if len(recent) > self._limit:
            both = np.concatenate([np.fromiter(recent.keys(), np.uint64, len(recent)), self._keys])
            self._keys, first = np.unique(both, return_index=True)  # the first of equals is the recent one
            self._counts = np.concatenate([np.fromiter(recent.values(), np.int64, len(recent)), self._counts])[first]
            recent.clear()
        return out


def _tokenise(path: str, capacity: int, end_id: int, groups: int) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, copies = workers.kept("packing", WordEncoder, path), Copies()
        task = np.uint64(TaskContext.get().partitionId())
        for batch in batches:
            workers.release()
            docs = batch.column(0).to_pylist()
            whole = [ids + end for ids in encoder.encode(batch.column(1))]
            sizes = np.array([len(ids) // 4 for ids in whole], np.uint64)
            sums = np.array([zlib.crc32(ids) for ids in whole], np.uint64)
            absent = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy().view(np.uint64)
            key = mix(ids + mix(sums * np.uint64(1 << 32) + sizes) + mix(absent.astype(np.uint64)))
            group = mix(key + mix(copies.number(key).view(np.uint64) * np.uint64(1 << 32) + task)) % np.uint64(groups)
            out: list[tuple] = []
            for doc_id, ids, n, sum_, own in zip(docs, whole, sizes.tolist(), sums.tolist(), group.tolist(), strict=True):
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, start, len(piece) // 4, sum_ if n <= capacity else zlib.crc32(piece), n, own))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _PIECES.replace(" long", "").split(", "))

    return run


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, all at most capacity: the longest first, each to the first bin with room.

    room[leaves + i] is what bin i has left, room[node] the larger of its two children, as in a tournament.
    """
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        node, need = 1, lengths[k]
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return bins, offsets


def _pack(capacity: int) -> Callable[[pa.Table], pa.Table]:
    """Sequences of a group's pieces; Arrow columns keep a long beside nulls, where a pandas frame would make it a double."""

    def run(pieces: pa.Table) -> pa.Table:
        ids = pieces["doc_id"].combine_chunks()
        number = {c: pieces[c].to_numpy() for c in ("start", "length", "ids_crc32", "doc_tokens", "group")}
        absent, known = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        order = np.lexsort((number["doc_tokens"], number["ids_crc32"], number["start"], known, absent, -number["length"]))
        bins, offsets = first_fit_decreasing(number["length"][order].tolist(), capacity)
        packed = pieces.take(pa.array(order)).drop_columns("group")
        packed = packed.append_column("sequence_id", pa.array(number["group"][order] * (1 << 32) + np.array(bins, np.int64)))
        return packed.append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packs documents (doc_id, text; null text: empty) into sequences of at most `capacity` ids.

    Every row counts as a document of its own, so repeated rows and equal or null ids are all packed; an
    empty text gives the end id alone; an empty table gives no rows; further columns are ignored. Returns
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for each piece.
    """
    tables.bounded_bytes(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_tokenise(tokenizer, capacity, end_id, groups), _PIECES)
    schema = _PIECES.replace("group long", "sequence_id long, offset long")
    return pieces.groupBy("group").applyInArrow(_pack(capacity), schema)
