"""Vectorised word and shingle hashing over Arrow string buffers.

A batch of texts is one byte buffer plus offsets.  Words are maximal runs of bytes other than ASCII white space
(0x20, 0x09-0x0D), with A-Z lower-cased.  Every word gets a 64-bit hash computed from eight-byte loads at the word
starts, so the work per character is two table look-ups and no Python object is made per word.

Nulls count as empty texts.  Hashes are 64 bits wide: two different words or shingles meet with probability about
2**-64 per pair, which is the one approximation of the operators that compare hashes instead of strings.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_C1, _C2, _SEED = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_LONG_WORD = 4096
#: Bytes of text handled at once: intermediate arrays stay in the processor's cache.
SLICE_BYTES = 1 << 21


def _return_memory() -> None:
    """Lets a worker give large buffers back when they are freed, instead of holding its highest need for good."""
    with contextlib.suppress(Exception):  # other C libraries have no such knobs
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 8 << 20)  # blocks from 8 MB on are mapped on their own
        libc.mallopt(-1, 16 << 20)  # free room at the top beyond 16 MB is given back
        pa.set_memory_pool(pa.system_memory_pool())


_return_memory()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U64(29))) * _C1
    h = (h ^ (h >> U64(32))) * _C2
    return h ^ (h >> U64(29))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by a plain sort, which is several times faster here than the hashing of np.unique."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col.cast(pa.string()) if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)) else col, "")
    wide = pa.types.is_large_string(col.type)
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or one row when that alone is larger."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """Words of some texts: hash, byte start and end of each, and where each text's words begin."""

    __slots__ = ("end", "h", "low", "off", "start")

    def __init__(self, buf: np.ndarray, offs: np.ndarray) -> None:
        n = int(offs[-1] - offs[0])
        low = np.zeros(n + 8, np.uint8)
        np.take(_LOWER, buf[offs[0] : offs[-1]], out=low[:n])
        rel = offs - offs[0]
        solid = _SOLID[low[:n]]
        first, last = solid.copy(), solid.copy()
        if n:
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            at = rel[:-1][rel[:-1] < n]
            first[at] = solid[at]
            at = rel[1:][rel[1:] > 0] - 1
            last[at] = solid[at]
        self.low, self.start, self.end = low, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, rel)
        size = self.end - self.start
        eight = np.ndarray((n + 1,), "<u8", buffer=low.data, strides=(1,))
        h = mix(size.astype(U64) * _C2 + _SEED)
        h = mix(h ^ (eight[self.start] & _MASK[np.minimum(size, 8)]))
        rest, k = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
        while rest.size:
            h[rest] = mix(h[rest] ^ (eight[self.start[rest] + k] & _MASK[np.minimum(size[rest] - k, 8)]))
            k += 8
            rest = rest[size[rest] > k]
        for i in np.flatnonzero(size > _LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(low[self.start[i] : self.end[i]].tobytes())
        self.h = h

    def doc(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def grams(self, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word shingles and each text's offsets into them.

        whole: a text of 1 to n-1 words gives its whole sequence as one shingle.
        """
        size = np.diff(self.off)
        many = np.maximum(size - n + 1, 0)
        if whole:
            many = np.where((size > 0) & (size < n), 1, many)
        off = np.concatenate([[0], np.cumsum(many)])
        g = chain(self.h, n)
        if not whole or not ((size > 0) & (size < n)).any():
            keep = np.ones(len(g), bool)
            if len(g):
                d = self.doc()
                keep = d[: len(g)] == d[n - 1 :]
            return g[keep], off
        out = np.empty(off[-1], U64)
        full = size >= n
        if full.any():
            src = np.repeat(self.off[:-1][full] - off[:-1][full], many[full]) + np.concatenate([np.arange(a, b) for a, b in zip(off[:-1][full], off[1:][full], strict=True)])
            out[np.concatenate([np.arange(a, b) for a, b in zip(off[:-1][full], off[1:][full], strict=True)])] = g[src]
        for i in np.flatnonzero((size > 0) & ~full):
            out[off[i]] = chain(self.h[self.off[i] : self.off[i + 1]], int(size[i]))[0] ^ mix(np.array([size[i]], U64))[0]
        return out, off


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    g = h[:m].copy()
    for j in range(1, n):
        g = (g ^ (g >> U64(31))) * _C1 + h[j : j + m]
    return mix(g)


def hash_words(text: str) -> np.ndarray:
    """Word hashes of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64)).h


def each(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Row range and words of consecutive slices of a column."""
    buf, offs = buffers(col)
    for a, b in slices(offs, limit):
        yield a, b, Words(buf, offs[a : b + 1])


class Members:
    """Fast membership of 64-bit values in a fixed set: a bitmap first, an exact search for what passes it."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = distinct(values.astype(U64))
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.values))))) + 5)
        self.shift = U64(64 - bits)
        self.map = np.zeros(1 << bits, bool)
        self.map[self.values >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of members, and each one's index in `values`."""
        at = np.flatnonzero(self.map[h >> self.shift])
        if not at.size or not len(self.values):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[k] == h[at]
        return at[ok], k[ok]
