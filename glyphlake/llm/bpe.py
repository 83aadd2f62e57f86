"""Byte-level BPE encoding and decoding with content-defined chunk reuse (operator 2).

A text is cut where a rolling hash of its last bytes says so, so texts that share a passage share its chunks
however the passage is shifted. A cut moves on to the next place where a letter or digit stands before
something else: every split of the text has an end there, and what it does on one side doesn't depend on the
other. The ids of a text are therefore those of its chunks, one after the other. A Python worker encodes a
chunk once and keeps it for all documents of its task; no text is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, workers
from .packing import Lately

#: Fixed value: the public split pattern of byte-level BPE vocabularies of this kind, as `re` writes it for
#: texts of ASCII and for those without characters that it puts into other classes than the tokenizer.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: A class of the tokenizer's pattern, and what it is in PATTERN.
CLASSES = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
#: Mean characters of a chunk (a power of two) and characters that the rolling hash sees.
CHUNK_CHARS = 512
WINDOW = 32
#: Chunks and pre-tokens a Python worker keeps.
MEMO_CHUNKS = 20_000
MEMO_PIECES = 500_000
#: Characters of texts that are encoded together, if no text alone is longer.
SLICE_CHARS = 1 << 18
#: A pre-token's end depends on no more than this many characters after it.
LOOKAHEAD = 3

#: Something that is neither letter nor digit, after one that is.
_APART = re.compile(r"(?<=[^\W_])[\x00-/:-@\[-`{-\x7f\u2000-\u206f\u3001-\u3003\uff01-\uff0f]")
_GEAR = np.random.default_rng(7).integers(0, 2**32, 65536, dtype=np.uint32)


def cut_points(text: str, mean: int = CHUNK_CHARS) -> list[int]:
    """Ends of the content-defined chunks of a text, its length last.

    The hash of a place is the sum over the last WINDOW characters of a random word for the character shifted
    by its distance; doubling sums make that log2(WINDOW) vector steps. The first place from one on where the
    hash's top bits are 0 that no pre-token spans, by _APART, is an end.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _GEAR[codes & 0xFFFF]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    bits = mean.bit_length() - 1
    ends = [0]
    for place in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
        if place > ends[-1]:
            found = _APART.search(text, place)
            if not found:
                break
            ends.append(found.start())
    return [*ends[1:], len(text)]


class ChunkCodec:
    """Encodes and decodes with a byte-level BPE tokenizer file; see the module."""

    def __init__(self, path: str, mean: int = CHUNK_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._split_ascii, self._split = re.compile(ASCII_PATTERN).findall, re.compile(PATTERN).findall
        self._odd = re.compile("[" + "".join(map(re.escape, _other_classes())) + "\ud800-\udfff\U00010000-\U0010ffff]").search
        self._mean = mean
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        self._pieces = Lately(MEMO_PIECES)
        self._chunks: dict[str, bytes] = {}
        self.bytes_of = _token_bytes(spec)
        self._opens = np.array([b[:1] == b" " for b in self.bytes_of])
        self._sizes = np.array(list(map(len, self.bytes_of)))
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, each as little-endian 32-bit integers."""
        out = list(map(self._pieces.new.get, pieces))
        if None in out:
            at = [i for i, ids in enumerate(out) if ids is None]
            if missing := self._pieces.missing({pieces[i] for i in at}):
                self._learn(missing)
            known = self._pieces.new
            for i in at:
                out[i] = known[pieces[i]]
        return out

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii():
            return self._split_ascii(text)
        if self._odd(text):
            return [text[a:b] for _, (a, b) in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self._split(text)

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token; strings of special tokens are ordinary text."""
        return [len(ids) // 4 for ids in self._ids(pieces)]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pre-tokens: those of a space and letters as one text, cut again before ids that start with a space."""
        words, other = [], []
        for p in pieces:
            (words if p[0] == " " and p[1:].isalpha() else other).append(p)
        if words:
            ids = np.array(self._tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4")
            starts = (4 * np.flatnonzero(self._opens[ids])).tolist()
            if len(starts) == len(words):
                data, ends = ids.tobytes(), [*starts[1:], 4 * len(ids)]
                self._pieces.new.update((w, data[a:b]) for w, a, b in zip(words, starts, ends, strict=True))
            else:
                other = pieces
        encoded = self._tokenizer.encode_batch_fast(other, add_special_tokens=False)
        self._pieces.new.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(other, encoded, strict=True))

    def _learn_chunks(self, chunks: set[str]) -> None:
        """Encodes chunks, all their pre-tokens together, and keeps them for the next text that holds one."""
        split = [self.pieces(c) for c in chunks]
        ids = self._ids(list(chain.from_iterable(split)))
        if len(self._chunks) + len(chunks) > MEMO_CHUNKS:
            self._chunks.clear()
        at = 0
        for chunk, pieces in zip(chunks, split, strict=True):
            self._chunks[chunk] = b"".join(ids[at : at + len(pieces)])
            at += len(pieces)

    def _parts(self, text: str) -> list[str | bytes]:
        """The chunks of a text, and ids of the special tokens between them."""
        plain = not self._special_split or not any(map(text.__contains__, self._special))
        out: list[str | bytes] = []
        for i, part in enumerate([text] if plain else self._special_split.split(text)):
            if i % 2:
                out.append(np.array([self._special[part]], "<u4").tobytes())
            elif part:
                ends = cut_points(part, self._mean)
                out += [part[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _together(self, texts: list[str | None]) -> list[bytes]:
        parts = [self._parts(t) if t else [] for t in texts]
        missing = {p for some in parts for p in some if isinstance(p, str) and p not in self._chunks}
        kept = {p: self._chunks[p] for some in parts for p in some if isinstance(p, str) and p not in missing}
        self._learn_chunks(missing)
        known = self._chunks
        known.update(kept)  # if they were dropped just now
        return [b"".join([known[p] if isinstance(p, str) else p for p in some]) for some in parts]

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """`encode` of each text; texts of SLICE_CHARS are encoded together."""
        some, chars = [], 0
        for text in texts:
            if some and chars + len(text or "") > SLICE_CHARS:
                yield from self._together(some)
                some, chars = [], 0
            some.append(text)
            chars += len(text or "")
        yield from self._together(some)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers; strings of special tokens are those tokens."""
        return self._together([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        out, data = [], np.frombuffer(ids, "<u4")
        for lo in range(0, len(data), SLICE_CHARS):  # eight bytes and more for each byte of a slice
            some = data[lo : lo + SLICE_CHARS]
            sizes = self._sizes[some]
            stops = np.cumsum(sizes)
            out.append(self._pool[np.repeat(self._starts[some] - (stops - sizes), sizes) + np.arange(stops[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def chunk_codec(path: str, mean: int) -> ChunkCodec:
    """One codec for each Python worker, so that later tasks find the chunks of earlier ones."""
    return workers.kept("bpe", ChunkCodec, path, mean)


@functools.cache
def _other_classes() -> list[str]:
    """Characters up to U+FFFF that `re` and the tokenizers library, of another version of Unicode, put into different classes."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    found: set[str] = set()
    for theirs, ours in CLASSES:
        found |= {c for c, _ in pre_tokenizers.Split(Regex(theirs), "removed", invert=True).pre_tokenize_str(every)} ^ set(re.findall(ours, every))
    return sorted(found)


def _token_bytes(spec: dict) -> list[bytes]:
    """Bytes of each id. A vocabulary writes a byte as the character of that code if it is printable in Latin-1,
    else as the next character from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        table[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return table


_ROUND = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _round_trip(path: str, mean: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(path, mean)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for ids in codec.encode_all(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str, mean: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(path, mean)
        for batch in batches:
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in codec.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(path, CHUNK_CHARS)
        for batch in batches:
            texts = [codec.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    tables.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id and ids (array<int>) of each row of docs (doc_id, text).

    Each row is encoded by itself: repeated rows and null ids give a row each; a null or empty text gives no
    ids; an empty table gives no rows; further columns are ignored; long texts aren't cut.
    """
    return _rows(docs).mapInArrow(_encode(tokenizer, chunk_chars), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids); null ids give an empty text."""
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decode(tokenizer), "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Number and SHA-256 of the ids of each row, and SHA-256 of the text they decode to; rows as `encode` has them."""
    return _rows(docs).mapInArrow(_round_trip(tokenizer, chunk_chars), _ROUND)
