"""Vectorised word splitting and hashing over Arrow string columns.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D. Everything
works on the UTF-8 buffer of a whole slice of rows at once; only the caller's loop is per
slice, so neither words nor characters become Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)
#: Bytes of text handled at a time; bounds the memory of one Python worker.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection on 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def plain(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One contiguous large_string array with nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.LargeStringArray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    offsets = _offsets(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _offsets(column: pa.LargeStringArray) -> np.ndarray:
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


@dataclass
class Words:
    """``buf[starts[i]:ends[i]]`` is word i; row d has words ``ptr[d]`` to ``ptr[d + 1]``."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        pad = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(self.buf) + 1,), "<u8", pad.data, strides=(1,))
        size = self.ends - self.starts
        h = lanes[self.starts] if len(self.starts) else np.zeros(0, U64)
        h = mix((h & _MASK[np.minimum(size, 8)]) ^ (size.astype(U64) * U64(0x9E3779B97F4A7C15)))
        at, j = np.flatnonzero(size > 8), 8
        while len(at):
            lane = lanes[self.starts[at] + j] & _MASK[np.minimum(size[at] - j, 8)]
            h[at] = mix(h[at] * U64(0x9FB21C651E98DF25) + lane)
            j += 8
            at = at[size[at] > j]
        return h

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def split(column: pa.LargeStringArray, lower: bool = True) -> Words:
    """Words of every row; ``lower`` maps A-Z to a-z first."""
    offsets = _offsets(column)
    if not len(column) or offsets[-1] == offsets[0]:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(len(column) + 1, np.int64))
    buf = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        buf = LOWER[buf]
    inside = ~SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = inside[edge]
    edge = offsets[1:][np.diff(offsets) > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offsets))


def counted(h: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often (or with which total weight) they occur."""
    if not len(h):
        return h, np.zeros(0, np.int64)
    if weights is None:
        h = np.sort(h)
    else:
        order = np.argsort(h, kind="stable")
        h, weights = h[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    if weights is None:
        return h[at], np.diff(np.append(at, len(h)))
    return h[at], np.add.reduceat(weights, at)
