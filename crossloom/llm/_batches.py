"""Whole texts of an Arrow column as bytes in numpy: words, hashes of words, hashes of word windows, without Python loops.

A word's hash takes its lower-cased bytes in lanes of eight: each lane is mixed, by a bijection of 64 bits, with what the lanes
before it gave, starting from the length. So words of the same length of up to eight bytes never share a hash, and longer ones do so
with a chance of 2^-64 for each pair, whatever they have in common: a hash isn't a sum over places, which texts of a regular
structure could cancel out. Words of more than ``LANE_BYTES`` bytes are hashed by xxh3. Batches are cut where they
reach ``CHUNK_BYTES``, never inside a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 18
LANE_BYTES = 128
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keep the first 0 to 8 bytes of a lane.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: SPACES: [\x20\x09-\x0D]
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them); null texts are empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of the texts of a chunk: ``start`` and ``end`` in bytes, ``first``: index of each text's first word (and
    after the last), ``doc``: index of the text, ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        n = len(data)
        gap = np.empty(n + 1, bool)
        gap[:n] = separators[data]
        gap[n] = True
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        after = np.empty(n + 1, bool)
        after[0] = True
        after[1:] = gap[:n]
        self.start = np.flatnonzero(~gap & (after | edge))
        self.end = np.flatnonzero(~after & (gap | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self._bytes = np.zeros(n + 8, np.uint8)
        np.take(_LOWER, data, out=self._bytes[:n])
        self._lanes = np.ndarray((n + 1,), "<u8", self._bytes, strides=(1,))
        self.hash = self.slices(self.start, self.end)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of slices of the lower-cased bytes."""
        size = end - start
        h = mix((size.astype(np.uint64) + np.uint64(1)) * _ODD)
        h = mix(h ^ (self._lanes[start] & _KEEP[np.minimum(size, 8)]))
        more = np.flatnonzero(size > 8)
        for at in range(8, LANE_BYTES, 8):
            if not len(more):
                break
            left = size[more] - at
            h[more] = mix(h[more] ^ (self._lanes[start[more] + at] & _KEEP[np.minimum(left, 8)]))
            more = more[left > 8]
        for k in more:
            h[k] = xxhash.xxh3_64_intdigest(self._bytes[start[k] : end[k]].tobytes())
        return h


def _link(so_far: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = (so_far ^ h) * _ODD
    x ^= x >> np.uint64(29)
    return x


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of ``size`` words; a text of fewer words, but not none, is one run."""
    h, m = words.hash, len(words.hash)
    first, count = words.first[:-1], words.count
    full = np.zeros(m, np.uint64)
    for k in range(min(size, m)):
        full[: m - k] = _link(full[: m - k], h[k:])
    at = np.arange(m)
    ok = at + size <= words.first[1:][words.doc]
    doc, out = words.doc[ok], mix(full[ok])
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = count[few].astype(np.uint64)
        for k in range(size - 1):
            on = count[few] > k
            short[on] = _link(short[on], h[first[few[on]] + k])
        doc, out = np.append(doc, few), np.append(out, mix(short))
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, out
