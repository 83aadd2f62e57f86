"""Words of Arrow string columns as NumPy arrays, and 64-bit hashes of words and of runs of words.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Hashes depend on the bytes alone, so any
task of any executor gives a text the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        kept[0] = 1
        np.cumprod(kept, out=kept)
        if n <= 8 * SLICE_BYTES:
            _POWERS[base] = kept
    return kept[:n]


@dataclass
class Slice:
    """Texts lo..hi of a column: their bytes, each text's offsets, and its words in order."""

    lo: int
    hi: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # of texts in data, hi - lo + 1
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    doc: np.ndarray  # of words, from 0
    first: np.ndarray  # index of each text's first word, hi - lo + 1

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_BASE, n), out=sums[1:])
        inverse = _powers(pow(_BASE, -1, 2**64), n + 1)
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))


def slices(column: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """Cuts a column of texts (null: empty) into slices of about SLICE_BYTES; lower folds A-Z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, n)
        part = data[offsets[lo] : offsets[hi]]
        yield _slice(lo, hi, _LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _slice(lo: int, hi: int, data: np.ndarray, offsets: np.ndarray) -> Slice:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(starts)
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(hi - lo), np.diff(first))
    return Slice(lo, hi, data, offsets, starts, np.flatnonzero(ends) + 1, doc, first)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions too near the end are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _STEP
        out += hashes[i : i + n]
    return mix(out)
