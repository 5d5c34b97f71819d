"""Exact Jaccard join of word-shingle sets, in the metric space of sets.

The Jaccard distance d(A, B) = 1 - |A & B| / |A u B| is a metric; two documents link when d <= r = 1 - percent / 100.
Classes of equal sets are single points of it.

1. *Neighbourhoods.*  Documents without shared text are at distance 1 from each other and from every pivot, so pivots
   cannot tell them apart, and Voronoi windows would copy all of them everywhere.  Sets that can link are therefore
   brought together first: the universe of shingles is hashed into K = k + 1 + e blocks, where k bounds |A ^ B| of a
   linked pair of a size class.  A linked pair agrees exactly on at least 1 + e blocks, so it shares a `region`: all
   sets with the same content in one block.  Sets near the border of a size class join the class below too.  A set
   skips blocks with fewer than two shingles unless more than e are such; with more than e empty blocks it adds its
   rarest-hash prefix.  No pair is left out.
2. *Clusters.*  256 counts of each set (more for long texts) bound its distance to any other from below.  Members of a region that this bound
   does not keep apart belong to one cluster (components of that relation, made from spanning edges).  A linked pair is
   always in one cluster, whose members are near copies of each other: distances there are spread, and pivots work.
3. *Voronoi recursion.*  Every cluster is joined by pivots, real sets of it, and exact distances.  What lies within r of
   a pivot is linked to it.  Each member's home is the cell of its nearest pivot; it is copied to each cell whose pivot is
   at most 2 r farther (the triangle inequality: the home of no partner can be farther).  Cells recurse until they are
   small, hold one component only, or do not shrink; then what the windows |d(x, p) - d(y, p)| <= r leave of the pairs
   from different components is compared.  Small clusters are joined in one task each, large ones are first dealt to cells
   by rounds of the same step over the cluster; cells that do not shrink are compared in blocks of bounded size.

Only spanning edges of links are written, never candidate pairs, so rows grow with members.

Equal sets are merged first (a copy costs nothing further) and links are found between different sets only.  Sets are
identified and compared by 64-bit hashes.

Cases: null, empty and wordless texts have an empty set and link with nothing; a null id is passed on as its own
component (null); repeated rows have equal sets and share a component; empty tables give no rows; extra columns are
ignored; fewer words than a shingle make one shingle of the whole sequence; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Stages, dealt, text_size
from .components import EDGES, components
from .lm import squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted

U64 = np.uint64
SKETCH = 256


@dataclass(frozen=True)
class JaccardParams:
    words: int = 4
    percent: int = 85
    #: Width of a size class.
    ratio: float = 1.35
    #: Further blocks, so that weak ones may be skipped.
    spare: float = 0.05
    batch_bytes: int = 4 << 20
    part_bytes: int = 24 << 20
    #: Flags of the filter that tells which sets are read again: at most 2**filter_bits, of which a broadcast takes an eighth in bytes.
    filter_bits: int = 28
    #: Members of a region, or of a cell, that one task compares; larger ones are cut into pairs of chunks.
    chunk: int = 1024
    #: A cluster beyond these sets or bytes is dealt to cells over several tasks.
    cell_sets: int = 2048
    cell_bytes: int = 16 << 20
    #: Pivots of a cell of a large cluster (about), and of a cell in a task.
    pivots: int = 16
    near_pivots: int = 6
    #: Cells in a task recurse down to so many members.
    leaf: int = 192
    #: Rounds over large clusters; cells that are still large are compared in chunks.
    rounds: int = 4


@lru_cache(maxsize=64)
def _classes(p: JaccardParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper size, blocks and spare blocks of every size class up to 2**31 shingles."""
    lo, uppers = 1, []
    while lo < 1 << 31:
        hi = max(lo, int(lo * p.ratio))
        uppers.append(hi)
        lo = hi + 1
    hi = np.array(uppers, np.int64)
    k = hi * (100 - p.percent) // p.percent
    e = np.round(p.spare * (k + 1)).astype(np.int64)
    return hi, np.where(k > 0, k + 1 + e, 0), e


def sets_of(words: tv.Words, p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text of a slice, one after another, and their offsets."""
    g, off = words.grams(p.words, whole=True)
    each = [tv.distinct(g[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    return (np.concatenate(each) if each else g), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


def identity(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One signed 64-bit number per set, 0 for the empty set."""
    if not len(g):
        return np.zeros(len(off) - 1, np.int64)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(tv.mix(g + U64(0x632BE59BD9B4E019)), dtype=U64)])
    h = tv.mix(total[off[1:]] - total[off[:-1]] + (off[1:] - off[:-1]).astype(U64))
    return np.where(off[1:] > off[:-1], h.view(np.int64), 0)


def keys(g: np.ndarray, off: np.ndarray, p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """Region keys of the sets, and the number of the set of each key."""
    hi, blocks, spare = _classes(p)
    size = np.diff(off)
    own = np.searchsorted(hi, size)
    out_k, out_s = [], []
    for below in (0, 1):
        c = own - below
        use = (c >= 0) & (size > 0)
        c = np.maximum(c, 0)
        if below:
            use &= size * p.percent <= hi[c] * 100
        use &= blocks[c] > 0
        pick = np.flatnonzero(use)
        if not len(pick):
            continue
        k = blocks[c[pick]]
        base = np.concatenate([[0], np.cumsum(k)])
        member = np.repeat(np.arange(len(pick)), size[pick])
        at = np.repeat(off[pick] - np.concatenate([[0], np.cumsum(size[pick])[:-1]]), size[pick]) + np.arange(len(member))
        h = g[at]
        where = (((tv.mix(h ^ U64(0x2545F4914F6CDD1D)) >> U64(32)) * k[member].astype(U64)) >> U64(32)).astype(np.int64) + base[member]
        n = np.bincount(where, minlength=base[-1])
        # sums of 64-bit hashes, in two exact halves
        low = np.bincount(where, (h & U64(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(U64)
        high = np.bincount(where, (h >> U64(32)).astype(np.float64), base[-1]).astype(U64)
        content = (high << U64(32)) + low
        owner = np.repeat(np.arange(len(pick)), k)
        e = spare[c[pick]]
        poor = np.bincount(owner, n < 2, len(pick)) > e
        bare = np.bincount(owner, n < 1, len(pick)) > e
        take = np.flatnonzero((n >= 2) | (poor[owner] & (n >= 1)))
        block = take - base[owner[take]]
        cls = c[pick][owner[take]]
        out_k.append(tv.mix(tv.mix(content[take]) + block.astype(U64) * U64(0x9E3779B97F4A7C15) + (cls.astype(U64) << U64(48))))
        out_s.append(pick[owner[take]])
        for i in np.flatnonzero(bare):  # rare: the prefix filter
            s = pick[i]
            a, b = off[s], off[s + 1]
            first = np.sort(tv.mix(g[a:b]))[: (b - a) - -(-p.percent * (b - a) // 100) + 1]
            out_k.append(tv.mix(first + (U64(0x7F4A7C15) ^ U64(c[s]))))
            out_s.append(np.full(len(first), s))
    if not out_k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_k), np.concatenate(out_s)


def sketch(g: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Shingles of each set in 256 blocks of the universe, or a finer power of two that keeps a block at about four:
    the distances to as many fixed pivots, up to a constant.  Saturated counts only shrink differences, so bounds hold."""
    size = np.diff(off)
    fine = np.ceil(np.log2(np.maximum(size, 1024) / 1024)).astype(np.int64)
    width = SKETCH << fine
    base = np.concatenate([[0], np.cumsum(width)])
    at = np.repeat(base[:-1], size) + (tv.mix(g ^ U64(0x8CB92BA72F3D8DD7)) >> np.repeat((56 - fine).astype(U64), size)).astype(np.int64)
    return np.split(np.minimum(np.bincount(at, minlength=base[-1]), 255).astype(np.uint8), base[1:-1])


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one matrix, by sums of neighbouring blocks down to the coarsest width."""
    width = min(map(len, sketches))
    if all(len(x) == width for x in sketches):
        return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, width).astype(np.int16)
    return np.stack([np.frombuffer(x, np.uint8).reshape(width, -1).sum(1, dtype=np.int16) for x in sketches])


def _each(stream: Iterator[pa.RecordBatch], column: int, p: JaccardParams) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in stream:
        buf, offs = tv.buffers(batch.column(column))
        for a, b in tv.slices(offs, p.batch_bytes):
            parts = [sets_of(tv.Words(buf, offs[a + c : a + d + 1]), p) for c, d in tv.slices(offs[a : b + 1])]
            size = np.concatenate([np.diff(o) for _, o in parts])
            yield batch, a, b, np.concatenate([g for g, _ in parts]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _first_of(ids: np.ndarray, g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different non-empty sets of a batch, each once."""
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first[ids[first] != 0])
    size = np.diff(off)[first]
    new = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(off[first] - new[:-1], size) + np.arange(new[-1])
    return ids[first], g[at], new


def document_sets(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """doc_id, n_shingles and set (its identity) of every document."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, g, off in _each(stream, 1, p):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(off)), pa.array(identity(g, off))], names=["doc_id", "n_shingles", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_shingles long, set long")


def _regions(docs: DataFrame, parts: int, p: JaccardParams) -> DataFrame:
    """members (identities, packed) of every region with at least two different sets."""
    edge = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(U64)

    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, g, off in _each(stream, 0, p):
            ids, g, off = _first_of(identity(g, off), g, off)
            k, s = keys(g, off, p)
            order = np.argsort(k)
            k, s = k[order], s[order]
            cut = [0, *np.searchsorted(k, edge), len(k)]
            rows = []
            for i in range(parts):
                if cut[i] < cut[i + 1]:
                    some, who = np.unique(s[cut[i] : cut[i + 1]], return_inverse=True)
                    rows.append((i, squeeze_sorted(k[cut[i] : cut[i + 1]]), squeeze(who.astype(np.uint32)), ids[some].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "who", "sets"])

    def meet(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, s = [], []
        for batch in stream:
            for r in batch.to_pylist():
                k.append(unsqueeze_sorted(r["keys"]))
                s.append(np.frombuffer(r["sets"], np.int64)[unsqueeze(r["who"], np.uint32)])
        k, s = np.concatenate(k), np.concatenate(s)
        order = np.lexsort([s, k])
        k, s = k[order], s[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s = k[fresh], s[fresh]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        end = np.append(start[1:], len(k))
        many = np.flatnonzero(end - start > 1)
        seen: set[bytes] = set()  # near copies share many regions; one of each membership is enough
        rows = []
        for i in many:
            members = s[start[i] : end[i]].tobytes()
            if members not in seen:
                seen.add(members)
                rows.append(members)
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["members"])
                rows = []
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["members"])

    asked = docs.select("text").mapInArrow(ask, "part int, keys binary, who binary, sets binary")
    return dealt(asked, parts, "part").groupBy("part").applyInArrow(meet, "members binary").distinct()


def _star(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each member and its region's smallest set."""
    for batch in stream:
        rows = [np.frombuffer(m, np.int64) for m in batch.column(0).to_pylist()]
        a = np.concatenate([np.repeat(m[0], len(m) - 1) for m in rows]) if rows else np.zeros(0, np.int64)
        b = np.concatenate([m[1:] for m in rows]) if rows else np.zeros(0, np.int64)
        pair = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits flags, set at the hashed place of every id: an upper bound of what to read again."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag = np.zeros(1 << bits, bool)
        for batch in stream:
            flag[_place(batch.column(0).to_numpy(), bits)] = True
        packed = np.packbits(flag).reshape(64, -1)
        for i in range(64):
            if packed[i].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([squeeze(packed[i])], pa.binary())], names=["block", "flags"])

    def join(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, block = None, 0
        for batch in stream:
            for r in batch.to_pylist():
                one, block = unsqueeze(r["flags"], np.uint8), r["block"]
                flags = one if flags is None else flags | one
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([squeeze(flags)], pa.binary())], names=["block", "flags"])

    out = np.zeros((64, (1 << bits) // 512), np.uint8)
    for r in ids.mapInArrow(run, "block int, flags binary").groupBy("block").applyInArrow(join, "block int, flags binary").collect():  # 2**bits flags at most
        out[r["block"]] = unsqueeze(r["flags"], np.uint8)
    return out.reshape(-1)


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (tv.mix(ids.view(U64)) >> U64(64 - bits)).astype(np.int64)


def _again(docs: DataFrame, wanted: DataFrame, p: JaccardParams, column: str) -> DataFrame:
    """set, n (its size) and its sketch or shingles, for the wanted sets (column `set`), read again from the documents."""
    bits = min(p.filter_bits, max(16, 4 + wanted.count().bit_length()))
    flags = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("set"), bits))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, g, off in _each(stream, 0, p):
            ids = identity(g, off)
            at = _place(ids, bits)
            ids = np.where((flags.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1, ids, 0)
            ids, g, off = _first_of(ids, g, off)
            if column == "sketch":
                data = [x.tobytes() for x in sketch(g, off)] if len(ids) else []
            else:
                data = [g[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(off)), pa.array(data, pa.binary())], names=["set", "n", column])

    found = docs.select("text").mapInArrow(run, f"set long, n long, {column} binary")
    return found.groupBy("set").agg(F.first("n").alias("n"), F.first(column).alias(column)).join(wanted, "set")


def _plausible(pairs: DataFrame, sketches: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs (a, b) that the distances to the fixed pivots do not exclude; their sets are not moved for that."""
    bound = (100 - p.percent) / (100 + p.percent)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            keep = np.zeros(len(x), bool)
            width = np.array([min(len(a), len(b)) for a, b in zip(x, y, strict=True)])
            for w in np.unique(width):
                some = np.flatnonzero(width == w)
                rows = folded([bytes(w), *(x[i] for i in some), *(y[i] for i in some)])[1:]
                keep[some] = np.abs(rows[: len(some)] - rows[len(some) :]).sum(1, dtype=np.int64) <= bound * size[some] + 1e-9
            yield batch.select([0, 1]).filter(pa.array(keep))

    right = sketches.select(F.col("set").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("m"))
    left = sketches.select(F.col("set").alias("a"), F.col("sketch").alias("x"), "n")
    fits = F.abs(F.col("n") - F.col("m")) <= bound * (F.col("n") + F.col("m")) + 1e-9
    return pairs.join(right, "b").join(left, "a").filter(fits).select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def merge(label: np.ndarray, members: np.ndarray) -> None:
    """Gives the components of the members one label, in place."""
    old = np.unique(label[members])
    if len(old) > 1:
        label[np.isin(label, old[1:])] = old[0]


def _open(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Probes that cover every pair of `one` and `two` with different labels: an index and those it is compared with.

    Pairs inside the largest component need no look, so a probe is a member of another one.
    """
    some, n = np.unique(label[two], return_counts=True)
    top = some[n.argmax()]
    inner = one[label[one] == top]
    return [(x, two) for x in one[label[one] != top].tolist()] + [(y, inner) for y in two[label[two] != top].tolist() if len(inner)]


def bridge(sizes: np.ndarray, sketches: np.ndarray, label: np.ndarray, one: np.ndarray, two: np.ndarray, p: JaccardParams) -> None:
    """Merges the labels of members (of `one` with those of `two`) that the distances to the fixed pivots do not keep apart."""
    bound = (100 - p.percent) / (100 + p.percent)
    for x, others in _open(label, one, two):
        y = others[label[others] != label[x]]
        y = y[np.abs(sizes[y] - sizes[x]) <= bound * (sizes[y] + sizes[x]) + 1e-9]
        if len(y):
            gap = np.abs(sketches[y] - sketches[x]).sum(1, dtype=np.int64)
            near = y[gap <= bound * (sizes[y] + sizes[x]) + 1e-9]
            if len(near):
                merge(label, np.append(near, x))


class Cell:
    """Sets of one cluster with their shingles renumbered, for exact distances.

    size: given where the sets are stored as differences from one common set D (A ^ D for A); then |A ^ B| is that of
    the differences, and near copies cost little.
    """

    def __init__(self, sets: list[np.ndarray], size: np.ndarray | None = None) -> None:
        self.kept = np.array([len(x) for x in sets], np.int64)
        self.size = self.kept if size is None else size
        self.off = np.concatenate([[0], np.cumsum(self.kept)])
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.at = at.astype(np.int32)
        self.mark = np.zeros(int(at.max()) + 1 if len(at) else 0, bool)

    def shared(self, x: int, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set x with the members."""
        own = self.at[self.off[x] : self.off[x + 1]]
        self.mark[own] = True
        kept = self.kept[members]
        if len(members) == len(self.kept):
            hit = self.mark[self.at]
        else:
            new = np.cumsum(kept) - kept
            hit = self.mark[self.at[np.repeat(self.off[members] - new, kept) + np.arange(kept.sum())]]
        out = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[np.concatenate([[0], np.cumsum(kept)])]
        self.mark[own] = False
        return (self.size[x] + self.size[members] - self.kept[x] - kept + 2 * np.diff(out)) // 2

    def distance(self, x: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of set x to the members, and shared shingles."""
        both = self.shared(x, members)
        return 1.0 - both / (self.size[members] + self.size[x] - both), both

    def linked(self, x: int, members: np.ndarray, both: np.ndarray, p: JaccardParams) -> np.ndarray:
        return 100 * both >= p.percent * (self.size[members] + self.size[x] - both)


def voronoi(cell: Cell, home: np.ndarray, p: JaccardParams, splits: list[int] | None = None) -> np.ndarray:
    """Component labels (smallest index) of the sets, by all links of a home set with any other: pivots, cells, windows, recursion."""
    n, r = len(cell.size), 1 - p.percent / 100 + 1e-9
    label = np.arange(n)
    stack = [(np.flatnonzero(home), np.arange(n))]
    while stack:
        one, two = stack.pop()  # pairs of `one` with `two`, which holds `one`
        if not len(one) or (label[two] == label[two[0]]).all():
            continue
        far, at, own = [], one[0], np.isin(two, one, assume_unique=True)
        while len(far) < p.near_pivots:  # each pivot is the home member farthest from those before
            d, both = cell.distance(int(at), two)
            far.append(d)
            hit = two[cell.linked(int(at), two, both, p)]
            merge(label, np.append(hit, at))
            least = np.where(own, np.min(far, axis=0), -1.0)
            at = two[least.argmax()]
            if least.max() <= 0:
                break
        if (label[two] == label[two[0]]).all():
            continue
        far = np.stack(far, axis=1)
        mine, copied = far.argmin(1), far <= far.min(1, keepdims=True) + 2 * r
        if len(two) > p.leaf and len(one) > p.leaf // 8:
            parts = [(two[own & (mine == k)], two[copied[:, k]]) for k in range(far.shape[1])]
            if sum(len(a) * len(b) for a, b in parts) < 0.8 * len(one) * len(two) and all(len(a) < len(one) or len(b) < len(two) for a, b in parts):
                stack += parts
                if splits is not None:
                    splits.append(len(two))
                continue
        place = np.full(n, -1)
        place[two] = np.arange(len(two))
        for x, others in _open(label, one, two):
            y = others[label[others] != label[x]]
            if len(y):
                y = y[np.abs(far[place[y]] - far[place[x]]).max(1) <= r]
            if len(y):
                y = y[cell.linked(x, y, cell.shared(x, y), p)]
                if len(y):
                    merge(label, np.append(y, x))
    return label


def _members(regions: DataFrame, p: JaccardParams) -> DataFrame:
    """small, first (smallest member), region, set, chunk, chunks: the members of regions of three and more (pairs are stars already)."""
    member = regions.select(F.monotonically_increasing_id().alias("region"), "members")

    def explode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()]
            size = [len(m) for m in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([n <= 256 for n in size], size).astype(bool)), pa.array(np.repeat([m[0] for m in rows], size).astype(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)), pa.array(np.concatenate([np.arange(n) // p.chunk for n in size]) if rows else np.zeros(0, np.int64)), pa.array(np.repeat([-(-n // p.chunk) for n in size], size).astype(np.int64))],
                names=["small", "first", "region", "set", "chunk", "chunks"],
            )

    return member.filter(F.length("members") > 16).mapInArrow(explode, "small boolean, first long, region long, set long, chunk long, chunks long")


def _bridges(flat: DataFrame, labels: DataFrame, sketches: DataFrame, p: JaccardParams) -> DataFrame:
    """Spanning edges (u, v) between components of sets that share a region and may be similar."""
    named = flat.join(labels.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("label", F.coalesce("component", "set")).drop("component")
    mixed = named.groupBy("region").agg((F.min("label") != F.max("label")).alias("open")).filter("open").select("region")
    rows = named.join(mixed, "region").join(sketches, "set")
    # a region of several chunks becomes all pairs of chunks, each a group of bounded size; small regions share groups
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("lo", F.least("chunk", "with")).withColumn("hi", F.greatest("chunk", "with"))
    shared = max(1, flat.count() // 10_000)
    rows = rows.withColumn("group", F.when(F.col("small"), -1 - F.pmod(F.xxhash64("first"), F.lit(shared))).otherwise(F.col("region")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("region", kind="stable")
        region = pdf["region"].to_numpy(np.int64)
        names, label = np.unique(pdf["label"].to_numpy(np.int64), return_inverse=True)
        known = np.arange(len(names))  # components that the regions of this group have joined so far
        sizes = pdf["n"].to_numpy(np.int64)
        sketches = pdf["sketch"].tolist()
        high = (pdf["chunk"] == pdf["hi"]).to_numpy()
        across = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
        cut = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            before = known[label[i:j]]
            now = before.copy()
            if (now == now[0]).all():
                continue
            every = np.arange(j - i)
            bridge(sizes[i:j], folded(sketches[i:j]), now, every[~high[i:j]] if across else every, every[high[i:j]] if across else every, p)
            for new in np.unique(now[now != before]):
                merge(known, np.unique(np.append(before[now == new], new)))
        apart = known != np.arange(len(names))
        return pd.DataFrame({"u": names[apart], "v": names[known[apart]]})

    return rows.select("group", "region", "set", "chunk", "lo", "hi", "label", "n", "sketch").groupBy("group", "lo", "hi").applyInPandas(run, "u long, v long").distinct()


def _sets(col: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, U64) for x in col.to_pylist()]


def _joined(cells: DataFrame, group, p: JaccardParams) -> DataFrame:
    """Spanning edges of the links of every cell; cells (key, home, set, n, shingles) share tasks by `group`."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        key, ids, home, size = (table.column(c).to_numpy()[order] for c in ("key", "set", "home", "n"))
        sets = _sets(table.column("shingles"))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else [0]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i > 1:
                label = voronoi(Cell([sets[k] for k in order[i:j]], size[i:j]), home[i:j].astype(bool), p)
                child = np.flatnonzero(label != np.arange(j - i))
                us.append(ids[i:j][child])
                vs.append(ids[i:j][label[child]])
        return pa.table({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})

    return cells.select(group.alias("group"), "key", "home", "set", "n", "shingles").groupBy("group").applyInArrow(run, EDGES).filter("u <> v")


def _split(cells: DataFrame, big: DataFrame, depth: int, p: JaccardParams) -> DataFrame:
    """One round over large cells: edges to pivots (u, v), places (key, new, set, home) in the pivots' cells, and members
    (key, set, n, rest), whose shingles are stored as the difference from the cell's first pivot."""
    r = 1 - p.percent / 100 + 1e-9
    rows = cells.join(big.select("key", F.col("n").alias("members"), "salts"), "key")
    pivots = rows.filter(F.col("home") & (F.pmod(F.xxhash64("set", F.lit(depth)), F.greatest(F.lit(1), F.floor(F.col("members") / p.pivots))) == 0))
    pivots = pivots.select("key", "set", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).toDF("cell", "pivot", "own", "task")
    rows = rows.select("key", "home", "set", "n", "shingles", F.pmod(F.xxhash64("set", F.lit("salt")), "salts").alias("salt"))
    types = {"u": pa.int64(), "v": pa.int64(), "key": pa.int64(), "new": pa.int64(), "set": pa.int64(), "home": pa.int64(), "n": pa.int64(), "rest": pa.binary()}

    def table(parts: dict) -> pa.Table:
        rows = len(next(iter(parts.values())))
        return pa.table({k: pa.array(parts[k], t) if k in parts else pa.nulls(rows, t) for k, t in types.items()})

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        if not n:
            return table({"u": []})
        ids, home, key, size = (left.column(c).to_numpy() for c in ("set", "home", "key", "n"))
        sets = _sets(left.column("shingles"))
        if not m:  # no pivot was drawn: the cell stays as it is
            return pa.concat_tables([table({"key": key, "new": key, "set": ids, "home": home.astype(np.int64)}), table({"key": key, "set": ids, "n": size, "rest": [x.tobytes() for x in sets]})])
        right = right.sort_by("pivot")
        at, own = right.column("pivot").to_numpy(), _sets(right.column("own"))
        cell, members = Cell(sets + own), np.arange(n)
        far, us, vs = np.zeros((n, m)), [], []
        for k in range(m):
            far[:, k], both = cell.distance(n + k, members)
            hit = members[cell.linked(n + k, members, both, p)]
            us.append(ids[hit])
            vs.append(np.full(len(hit), at[k]))
        row, k = np.nonzero(far <= far.min(1, keepdims=True) + 2 * r)
        new = tv.mix(key[row].view(U64) + tv.mix(at[k].view(U64))).view(np.int64)
        places = {"key": key[row], "new": new, "set": ids[row], "home": (home[row] & (far.argmin(1)[row] == k)).astype(np.int64)}
        rest = {"key": key, "set": ids, "n": size, "rest": [np.setxor1d(x, own[0], assume_unique=True).tobytes() for x in sets]}
        return pa.concat_tables([table({"u": np.concatenate(us), "v": np.concatenate(vs)}), table(places), table(rest)])

    return rows.groupBy("key", "salt").cogroup(pivots.groupBy("cell", "task")).applyInArrow(visit, "u long, v long, key long, new long, set long, home long, n long, rest binary")


def _compared(members: DataFrame, labels: DataFrame, p: JaccardParams) -> DataFrame:
    """Spanning edges of large cells whose windows hold nearly everything: what is not in a cell's largest component against all, in chunks."""
    named = members.join(labels.select(F.col("node").alias("set"), "component"), "set", "left").select("key", "set", "n", F.col("rest").alias("shingles"), F.coalesce("component", "set").alias("label"))
    per = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    per = per.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("most"), (F.sum("bytes") - F.max_by("bytes", F.struct("n", "label"))).alias("other"))
    chunks = lambda n, size: F.greatest(F.ceil(n / F.lit(2 * p.chunk)), F.ceil(size / F.lit(p.cell_bytes)), F.lit(1)).cast("long")
    per = per.filter("most < n").select("key", "top", chunks(F.col("n") - F.col("most"), F.col("other")).alias("probes"), chunks(F.col("n"), F.col("bytes")).alias("parts"))
    rows = named.join(per, "key")
    probe = rows.filter("label <> top").select("key", F.pmod(F.xxhash64("set"), "probes").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), F.lit(True).alias("home"), "set", "n", "shingles")
    every = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("probes") - 1)).alias("i"), F.pmod(F.xxhash64("set"), "parts").alias("j"), F.lit(False).alias("home"), "set", "n", "shingles")
    both = probe.unionAll(every).withColumn("key", F.xxhash64("key", "i", "j"))
    return _joined(both, F.col("key"), p)


def _clusters(cells: DataFrame, p: JaccardParams, stages: Stages) -> DataFrame:
    """Spanning edges (u, v) of the links inside the cells (key, home, set, n, shingles)."""
    edges = None
    for depth in range(p.rounds + 1):
        size = stages.write(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum("n")).alias("bytes")), f"size-{depth}")
        large = (F.col("n") > p.cell_sets) | ((F.col("bytes") > p.cell_bytes) & (F.col("n") > 2))
        total, many = size.filter(~large).agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
        if many:
            groups = max(1, -(-2 * total // p.cell_bytes))
            small = cells.join(size.filter(~large & (F.col("n") > 1)).select("key"), "key")
            some = stages.write(_joined(small, F.pmod(F.xxhash64("key"), F.lit(groups)), p), f"links-{depth}")
            edges = some if edges is None else edges.unionAll(some)
        big = size.filter(large).withColumn("salts", F.greatest(F.ceil(F.col("n") / p.chunk), F.ceil(F.col("bytes") / p.cell_bytes)).cast("long"))
        if big.isEmpty():
            break
        cells = cells.join(big.select("key"), "key")
        round_ = stages.write(_split(cells, big, depth, p), f"split-{depth}")
        some = round_.filter("u is not null and u <> v").select("u", "v")
        edges = some if edges is None else edges.unionAll(some)
        labels = components(edges, stages, f"labels-{depth}")
        place = round_.filter("new is not null")
        spread = place.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).join(big, "key").select("key", ((F.col("copies") > 3 * F.col("n")) | F.lit(depth == p.rounds)).alias("flat"))
        spread = stages.write(spread, f"spread-{depth}")
        flat = round_.filter("rest is not null").join(spread.filter("flat").select("key"), "key")
        edges = edges.unionAll(stages.write(_compared(flat, labels, p), f"compared-{depth}"))
        # cells that hold one component only are done
        named = place.join(spread.filter(~F.col("flat")).select("key"), "key").join(labels.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("label", F.coalesce("component", "set"))
        still = named.groupBy("new").agg((F.min("label") != F.max("label")).alias("open")).filter("open").select("new")
        named = stages.write(named.join(still, "new").select(F.col("new").alias("key"), (F.col("home") == 1).alias("home"), "set"), f"open-{depth}")
        if named.isEmpty():
            break
        shingles = cells.select("set", "n", "shingles").dropDuplicates(["set"])
        cells = stages.write(named.join(shingles, "set").select("key", "home", "set", "n", "shingles"), f"cells-{depth}")
    return edges if edges is not None else cells.sparkSession.createDataFrame([], EDGES)


def link(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    p = params
    stages = Stages(docs.sparkSession, "jaccard")
    _, size = text_size(docs, "text")
    sets = stages.write(document_sets(docs, p), "sets")
    parts = max(1, -(-size // p.part_bytes))
    regions = stages.write(_regions(docs, parts, p), "regions")
    pairs = stages.write(regions.mapInArrow(_star, "a long, b long").distinct(), "pairs")
    wanted = stages.write(pairs.select(F.col("a").alias("set")).unionAll(pairs.select("b")).distinct(), "wanted")
    sketches = stages.write(_again(docs, wanted, p, "sketch"), "sketches")
    near = stages.write(_plausible(pairs, sketches, p).toDF("u", "v"), "near")
    first = components(near, stages, "first")
    bridges = stages.write(_bridges(stages.write(_members(regions, p), "members"), first, sketches, p), "bridges")
    clusters = components(first.toDF("u", "v").unionAll(bridges), stages, "clusters")
    member = clusters.select(F.col("component").alias("key"), F.col("node").alias("set")).unionAll(clusters.select(F.col("component").alias("key"), F.col("component").alias("set")).distinct())
    member = stages.write(member, "member")
    stages.retain("sets", "member")
    cells = stages.write(_again(docs, member, p, "shingles").select("key", F.lit(True).alias("home"), "set", "n", "shingles"), "cells")
    stages.retain("sets", "cells")
    labels = components(_clusters(cells, p, stages), stages, "joined")
    # a component's number is its smallest document
    group = sets.filter("set <> 0").groupBy("set").agg(F.min("doc_id").alias("doc")).join(labels.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    low = group.groupBy("component").agg(F.min("doc").alias("component_id"))
    final = stages.write(group.join(low, "component").select("set", "component_id"), "final")
    stages.retain("sets", "final")
    return sets.join(final, "set", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, params: JaccardParams = JaccardParams(words=5, percent=80)) -> DataFrame:
    """The documents without near copies of an earlier one: of each component the one with the smallest id stays.

    Rows with a null id stay, as do those without shingles; rows that share the staying id are one document and all stay.
    """
    gone = link(docs, params).filter((F.col("doc_id") != F.col("component_id")) & (F.col("n_shingles") > 0)).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
