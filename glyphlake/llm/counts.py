"""Token counts that follow edits (operator 5).

A document keeps its pre-tokens in leaves of bounded size and, over the leaves, a segment tree of sums of
characters and of tokens. An edit finds its leaves by descending the sums of characters, splits again only
the edited characters with the pre-tokens around them, up to where the old split holds again, encodes
those pre-tokens, and updates the sums on the way to the root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .bpe import LOOKAHEAD, ChunkCodec, chunk_codec

#: Pre-tokens of a leaf.
LEAF = 64
#: Edits of the query: public patterns of personal data and secrets, and what takes their place.
SCRUBS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<email>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
    (r"(?<!\w)\+?\d[\d ()-]{7,}\d(?!\w)", "<phone>"),
    (r"\b(?:AKIA|sk-|ghp_)[A-Za-z0-9]{12,}\b", "<key>"),
)


class TokenTree:
    """Pre-tokens of one text with their token counts; see the module."""

    def __init__(self, text: str, codec: ChunkCodec, leaf: int = LEAF):
        self._codec, self._leaf = codec, leaf
        self.encoded = 0  # pre-tokens encoded by edits
        pieces = codec.pieces(text)
        self._leaves = [pieces[i : i + leaf] for i in range(0, len(pieces), leaf)] or [[]]
        self._build()

    def _sums(self, pieces: list[str]) -> tuple[int, int]:
        return sum(map(len, pieces)), sum(self._codec.counts(pieces))

    @classmethod
    def restored(cls, text: str, codec: ChunkCodec, lengths: list[int], sizes: list[int], tokens: list[int], leaf: int = LEAF) -> TokenTree:
        """The tree that gave that `state`; nothing is split or encoded."""
        tree = cls.__new__(cls)
        tree._codec, tree._leaf, tree.encoded = codec, leaf, 0
        ends = list(accumulate(lengths, initial=0))
        pieces = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        cuts = list(accumulate(sizes, initial=0))
        tree._leaves = [pieces[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [[]]
        tree._build(tokens)
        return tree

    def state(self) -> tuple[list[int], list[int], list[int]]:
        """Characters of each pre-token, pre-tokens of each leaf and tokens of each leaf."""
        lengths = [len(p) for leaf in self._leaves for p in leaf]
        return lengths, [len(leaf) for leaf in self._leaves], self._tokens[self._size : self._size + len(self._leaves)]

    def _build(self, tokens: list[int] | None = None) -> None:
        self._size = 1
        while self._size < len(self._leaves):
            self._size *= 2
        self._chars, self._tokens = [0] * (2 * self._size), [0] * (2 * self._size)
        for i, pieces in enumerate(self._leaves):
            self._chars[self._size + i], self._tokens[self._size + i] = (sum(map(len, pieces)), tokens[i]) if tokens else self._sums(pieces)
        for node in range(self._size - 1, 0, -1):
            self._pull(node)

    def _pull(self, node: int) -> None:
        self._chars[node] = self._chars[2 * node] + self._chars[2 * node + 1]
        self._tokens[node] = self._tokens[2 * node] + self._tokens[2 * node + 1]

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    @property
    def chars(self) -> int:
        return self._chars[1]

    @property
    def text(self) -> str:
        return "".join("".join(p) for p in self._leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` and the character it starts at."""
        node, before = 1, 0
        while node < self._size:
            node *= 2
            if at >= before + self._chars[node] and self._chars[node + 1]:
                before += self._chars[node]
                node += 1
        return node - self._size, before

    def edit(self, start: int, end: int, text: str) -> None:
        """Puts `text` in the place of characters start..end."""
        if not 0 <= start <= end <= self.chars:
            raise ValueError(f"edit {start}..{end} of {self.chars} characters")
        # context: the split before the edit is certain up to a pre-token that ends LOOKAHEAD characters before
        first, before = self._find(max(0, start - LOOKAHEAD - 1))
        inside, place = 0, before
        leaf = self._leaves[first]
        while inside < len(leaf) and place + len(leaf[inside]) < start - LOOKAHEAD:
            place += len(leaf[inside])
            inside += 1
        kept = leaf[:inside]
        last, last_before = self._find(min(end, max(0, self.chars - 1)))
        old: list[str] = [p for k in range(first, last + 1) for p in self._leaves[k]][inside:]
        joined = "".join(old)
        while True:
            window = joined[: start - place] + text + joined[end - place :]
            again = self._codec.pieces(window)
            whole = last == len(self._leaves) - 1
            olds, at, shift = {}, place, len(text) - (end - start)
            for i, p in enumerate(old):
                at += len(p)
                if at >= end:
                    olds[at + shift] = i + 1
            at, agreed = place, None
            for i, p in enumerate(again):
                at += len(p)
                if at >= place + len(window) - LOOKAHEAD:
                    break
                if at in olds and at > start + len(text):
                    agreed = i + 1, olds[at]
                    break
            if agreed or whole:
                break
            for k in range(last + 1, min(len(self._leaves), 2 * last - first + 2)):
                last = k
                old += self._leaves[k]
            joined = "".join(old)
        fresh, tail = (again[: agreed[0]], old[agreed[1] :]) if agreed else (again, [])
        self.encoded += len(fresh)
        pieces = kept + fresh + tail
        leaves = last - first + 1
        if len(pieces) <= 4 * self._leaf * leaves:
            # the same leaves hold the new pre-tokens; only their sums and those above change
            per = -(-len(pieces) // leaves) if pieces else 1
            for k in range(leaves):
                self._leaves[first + k] = pieces[k * per : (k + 1) * per]
                node = self._size + first + k
                self._chars[node], self._tokens[node] = self._sums(self._leaves[first + k])
            lo, hi = (self._size + first) // 2, (self._size + last) // 2
            while lo:
                for node in range(lo, hi + 1):
                    self._pull(node)
                lo, hi = lo // 2, hi // 2
        else:  # a long insertion: leaves are cut anew
            self._leaves[first : last + 1] = [pieces[i : i + self._leaf] for i in range(0, len(pieces), self._leaf)]
            self._build()


def find_edits(text: str, scrubs: tuple[tuple[str, str], ...] = SCRUBS) -> list[tuple[int, int, str]]:
    """Places that the patterns match, from left to right; of overlapping ones the first."""
    found = sorted((m.start(), m.end(), put) for pattern, put in scrubs for m in _compiled(pattern).finditer(text))
    out: list[tuple[int, int, str]] = []
    for start, end, put in found:
        if not out or start >= out[-1][1]:
            out.append((start, end, put))
    return out


_PATTERNS: dict[str, regex.Pattern] = {}


def _compiled(pattern: str) -> regex.Pattern:
    if pattern not in _PATTERNS:
        _PATTERNS[pattern] = regex.compile(pattern)
    return _PATTERNS[pattern]


_COUNTED = "doc_id long, n_tokens long, n_edits long, n_encoded long, n_tokens_after long"


def _count(path: str, scrubs: tuple[tuple[str, str], ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(path, 512)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                tree = TokenTree(text or "", codec)
                before, edits = tree.tokens, find_edits(text or "", scrubs)
                for start, end, put in reversed(edits):  # from the right, so places stay
                    tree.edit(start, end, put)
                rows.append((before, len(edits), tree.encoded, tree.tokens))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], [c.split()[0] for c in _COUNTED.split(", ")])

    return run


def count_after_edits(docs: DataFrame, tokenizer: str, scrubs: tuple[tuple[str, str], ...] = SCRUBS) -> DataFrame:
    """Tokens of each row of docs (doc_id, text) before and after the edits that `scrubs` find in it.

    n_tokens and n_tokens_after count what the tokenizer gives for the whole text and the whole edited text,
    where strings of special tokens are ordinary text; n_edits counts edits, n_encoded the pre-tokens that edits made it encode. Rows are counted
    alone: repeated rows and null ids give a row each; null and empty texts have no tokens; an empty table
    gives no rows; further columns are ignored.
    """
    tables.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(tokenizer, scrubs), _COUNTED)


_TREES = "doc_id long, text string, lengths array<int>, sizes array<int>, tokens array<int>, n_tokens long, n_encoded long"


def _rows(kept: list[tuple[TokenTree, object]]) -> pa.RecordBatch:
    states = [tree.state() for tree, _ in kept]
    columns = [pa.array([d for _, d in kept], pa.int64()), pa.array([tree.text for tree, _ in kept], pa.string())]
    columns += [pa.array([s[k] for s in states], pa.list_(pa.int32())) for k in range(3)]
    columns += [pa.array([tree.tokens for tree, _ in kept], pa.int64()), pa.array([tree.encoded for tree, _ in kept], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _TREES.split(", ")])


def trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The segment tree of each row of docs (doc_id, text; null: empty) as a row of _TREES, which `edited` goes on from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(tokenizer, 512)
        for batch in batches:
            yield _rows([(TokenTree(text or "", codec), d) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    tables.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _TREES)


def edited(kept: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of `trees` after edits (doc_id, start, end, put), places of which are those of the text before any of them.

    Only what edits touch is encoded again (n_encoded pre-tokens). An edit counts for all rows of its doc_id; a
    null put is empty; rows without edits, null ids included, stay as they are. Edits of one document that
    overlap, or lie outside its text, raise ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(tokenizer, 512)
        for batch in batches:
            out = []
            for d, text, lengths, sizes, tokens, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = TokenTree.restored(text, codec, lengths, sizes, tokens)
                before = tree.chars + 1
                for change in sorted(changes or [], key=lambda e: (e["start"], e["end"]), reverse=True):
                    if change["end"] > before:
                        raise ValueError(f"edits of document {d} overlap")
                    before = change["start"]
                    tree.edit(change["start"], change["end"], change["put"] or "")
                out.append((tree, d))
            yield _rows(out)

    tables.bounded_batches(kept.sparkSession)
    each = edits.groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "put")).alias("changes"))
    joined = kept.join(each, kept["doc_id"] == each["d"], "left")
    return joined.select("doc_id", "text", "lengths", "sizes", "tokens", "changes").mapInArrow(run, _TREES)
