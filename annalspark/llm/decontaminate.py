"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The local alignment score counts `match` per equal word, `mismatch` per substituted and `gap` per inserted or lost word,
so edited and partly paraphrased copies still score; a document is contaminated by an item if the score reaches
`threshold` of the item's own and the equal words reach `min_words` (or the whole item, if shorter).

Seeds lose nothing.  An alignment that passes pays for few edits, so some of its equal words, at least `least` of them,
are followed by the next equal word with one edit or none between the two.  A seed is therefore a word with the next or
the next but one.  Of an item's starts of seeds all but `least` - 1 are needed to meet every such alignment, and those
that are rarest in the documents are taken, after a count over all documents.  Where `least` is 0, as for items of two
words, single words are seeds, by the same argument on the equal words.  Around a seed, as many starts of seeds
of the item as a passing alignment has must stand before the two are aligned.

Items are taken in blocks whose seed tables are at most `block_grams` long, or one item; each block is broadcast (a
bound of a few MB) and the documents are read twice a block, for the counts and for the search.  Documents are never
shuffled; a row a seed and task is, for the counts.

Cases: null texts and items are empty and match nothing; null ids are passed on; repeated documents are each reported;
empty tables give no rows; extra columns are ignored.  A very long stretch of seeds is aligned in overlapping pieces of
bounded length, so memory is bounded too.  Ties: of equally good alignments of an item the first one counts; equal items
are each reported; of equally rare seeds the first ones are taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import place_of

#: Words of a long stretch that are aligned at once, about; pieces overlap by what an alignment can cover.
PIECE = 4096


@dataclass(frozen=True)
class SeedParams:
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.5
    min_words: int = 8
    block_grams: int = 200_000
    #: Items that the driver holds at a time, about.
    block_items: int = 20_000

    def equal(self, m: int) -> int:
        """Equal words of an item of m words that an alignment needs to pass."""
        return max(math.ceil(self.threshold * m - 1e-9), min(self.min_words, m))

    def edits(self, m: int, equal: int) -> int:
        """Edits that an alignment with so many equal words may have."""
        return int((self.match * equal - self.threshold * self.match * m) / min(-self.mismatch, -self.gap) + 1e-9)

    def close(self, m: int) -> int:
        """Equal words that the next one follows with one edit or none between, at least, where an alignment passes."""
        return max(0, min(e - 1 - self.edits(m, e) // 2 for e in range(self.equal(m), m + 1)))

    def reach(self, m: int) -> int:
        """Words of a document that an alignment covers, at most."""
        return m + self.edits(m, m) + 2


def grams(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of every word alone (step 0), or with the word `step` places on."""
    return tv.mix(tv.mix(h[:-step]) + h[step:]) if step else tv.mix(h)


@dataclass
class Item:
    """Words of an item; its seeds and the starts of each; how many starts an alignment that passes has."""

    id: object
    words: np.ndarray
    steps: tuple[int, ...]
    least: int
    gram: np.ndarray
    start: np.ndarray


def _item(item_id: object, h: np.ndarray, p: SeedParams) -> Item:
    least, steps = p.close(len(h)), (1, 2)
    if not least:
        least, steps = p.equal(len(h)), (0,)
    made = [grams(h, s) for s in steps]
    return Item(item_id, h, steps, least, np.concatenate(made), np.concatenate([np.arange(len(g)) for g in made]))


@dataclass
class Block:
    """Some benchmark items and the table from seed to item."""

    items: list[Item]
    gram: np.ndarray
    item: np.ndarray
    members: tv.Members
    steps: tuple[int, ...]


def blocks(items: list[tuple[object, str | None]], p: SeedParams) -> Iterator[Block]:
    """Items in blocks, with all their seeds."""
    held, size = [], 0
    for item_id, text in items:
        h = tv.hash_words(text or "")
        if not len(h):
            continue
        item = _item(item_id, h, p)
        if held and size + len(item.gram) > p.block_grams:
            yield _block(held, [x.gram for x in held])
            held, size = [], 0
        held.append(item)
        size += len(item.gram)
    if held:
        yield _block(held, [x.gram for x in held])


def _block(items: list[Item], seeds: list[np.ndarray]) -> Block:
    seeds = [tv.distinct(g) for g in seeds]
    gram, item = np.concatenate(seeds), np.repeat(np.arange(len(items)), [len(g) for g in seeds])
    order = np.lexsort([item, gram])
    return Block(items, gram[order], item[order], tv.Members(gram), tuple(sorted({s for x in items for s in x.steps})))


def rarest(block: Block, seen: np.ndarray) -> Block:
    """The block with the rarest seeds that meet every alignment that passes; seen: occurrences of each of its seeds."""
    seeds = []
    for x in block.items:
        cost = np.bincount(x.start, seen[np.searchsorted(block.members.values, x.gram)])
        kept = np.argsort(cost, kind="stable")[: len(cost) - x.least + 1]
        seeds.append(x.gram[np.isin(x.start, kept)])
    return _block(block.items, seeds)


def smith_waterman(doc: np.ndarray, item: np.ndarray, p: SeedParams) -> tuple[int, int, int, int]:
    """Best local score of an item in a document, the equal words of one best alignment, and its start and end."""
    m, n = len(item), len(doc)
    score = np.zeros((m + 1, n + 1), np.int32)
    ramp = np.arange(n + 1) * p.gap
    for i in range(1, m + 1):
        step = np.where(doc == item[i - 1], p.match, p.mismatch)
        row = np.maximum(np.maximum(score[i - 1, :-1] + step, score[i - 1, 1:] + p.gap), 0)
        # gaps along the row: a running maximum after taking out the gap's ramp
        score[i, 1:] = np.maximum.accumulate(row - ramp[1:]) + ramp[1:]
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    best, end, equal = int(score[i, j]), int(j), 0
    while i > 0 and j > 0 and score[i, j] > 0:
        same = doc[j - 1] == item[i - 1]
        if score[i, j] == score[i - 1, j - 1] + (p.match if same else p.mismatch):
            equal += bool(same)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + p.gap:
            i -= 1
        else:
            j -= 1
    return best, equal, int(j), end


def align(doc: np.ndarray, places: dict[int, np.ndarray], block: Block, p: SeedParams) -> list[tuple[int, float, int, int, int]]:
    """(item, score share, equal words, first word, end word) of the items whose alignment passes."""
    found = []
    for k, at in places.items():
        item, best = block.items[k], None
        m, reach = len(item.words), p.reach(len(item.words))
        for x, near in _stretches(doc, at, item, reach):
            score, equal, s, e = smith_waterman(near, item.words, p)
            share = score / (p.match * m)
            if share >= p.threshold and equal >= min(p.min_words, m) and (best is None or share > best[1]):
                best = (k, share, equal, x + s, x + e)
        if best:
            found.append(best)
    return found


def _stretches(doc: np.ndarray, at: np.ndarray, item: Item, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """First word and words of the stretches around seeds that have as many starts of seeds as an alignment needs."""
    for lo, hi in _runs(at, 2 * reach):
        x, y = max(0, at[lo] - reach), min(len(doc), at[hi] + reach)
        marked = np.zeros(y - x + 1, np.int64)
        for s in item.steps:
            g = grams(doc[x:y], s)
            marked[1 : len(g) + 1] |= np.isin(g, item.gram)
        before = np.cumsum(marked)
        near = at[lo : hi + 1]
        near = near[before[np.minimum(near - x + reach, y - x)] - before[np.maximum(near - x - reach, 0)] >= item.least]
        size = max(PIECE, 4 * reach)
        for a, b in _runs(near, reach):
            u, v = max(0, int(near[a]) - reach), min(len(doc), int(near[b]) + reach)
            for w in range(u, max(u + 1, v - reach), size - reach):
                yield w, doc[w : min(w + size, v)]


def _runs(at: np.ndarray, far: int) -> Iterator[tuple[int, int]]:
    """First and last index of runs of ascending places no further apart than `far`."""
    cut = np.flatnonzero(np.diff(at) > far)
    return zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(at) - 1], strict=True) if len(at) else iter(())


def _hits(words: tv.Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word position in it and distinct-seed number of every seed in a slice."""
    docs, pos, which = [], [], []
    doc = words.doc()
    for step in block.steps:
        at, k = block.members.find(grams(words.h, step))
        ok = doc[at] == doc[at + step]
        docs.append(doc[at[ok]])
        pos.append(at[ok] - words.off[doc[at[ok]]])
        which.append(k[ok])
    return np.concatenate(docs), np.concatenate(pos), np.concatenate(which)


def _occurrences(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each seed of a block stands in the documents; the result is as long as the block's table."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        seen = np.zeros(len(b.members.values), np.int64)
        for batch in batches:
            for _, _, words in tv.each(batch.column(0)):
                seen += np.bincount(_hits(words, b)[2], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["seed", "n"])

    rows = docs.select(F.col("text")).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    seen = np.zeros(len(block.members.values), np.int64)
    seen[rows.column("seed").to_numpy()] = rows.column("n").to_numpy()
    return seen


def _seeded(docs: DataFrame, benchmark: DataFrame, p: SeedParams) -> Iterator[Block]:
    """Blocks of the benchmark with the seeds that are rarest in the documents."""
    for block in blocks(_items(benchmark, p), p):
        yield rarest(block, _occurrences(docs, block))


def contaminated(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """doc_id, item_id, score, matched_words, start_word, end_word of every contaminated document and item."""
    spark = docs.sparkSession
    out = None
    for block in _seeded(docs, benchmark, params):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                rows = [(i, *x) for i, x in _found(batch.column(1), b, params)]
                at = pa.array([x[0] for x in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array([b.items[x[1]].id for x in rows], pa.int64()), pa.array([round(x[2], 6) for x in rows], pa.float64())] + [pa.array([x[c] for x in rows], pa.int64()) for c in (3, 4, 5)],
                    names=["doc_id", "item_id", "score", "matched_words", "start_word", "end_word"],
                )

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, item_id long, score double, matched_words long, start_word long, end_word long")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, score double, matched_words long, start_word long, end_word long")


def clean(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """The documents that no item contaminates, all their columns as they are."""
    spark = docs.sparkSession
    at, schema = place_of(docs, "text"), docs.schema
    for block in _seeded(docs, benchmark, params):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in _found(batch.column(at), b, params)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def _found(col: pa.Array, block: Block, p: SeedParams) -> Iterator[tuple[int, tuple]]:
    first = np.searchsorted(block.gram, block.members.values)
    many = np.searchsorted(block.gram, block.members.values, side="right") - first
    for a, _, words in tv.each(col):
        doc, pos, which = _hits(words, block)
        if not len(doc):
            continue
        n = many[which]
        item = block.item[np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        doc, pos = np.repeat(doc, n), np.repeat(pos, n)
        order = np.lexsort([pos, item, doc])
        doc, pos, item = doc[order], pos[order], item[order]
        pair = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
        for s, e in zip(pair, [*pair[1:], len(doc)], strict=True):
            d, k = int(doc[s]), int(item[s])
            for x in align(words.h[words.off[d] : words.off[d + 1]], {k: pos[s:e]}, block, p):
                yield a + d, x


def _items(benchmark: DataFrame, p: SeedParams) -> Iterator[tuple[object, str | None]]:
    """Items in an order of their own, a bounded number at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    parts = max(1, -(-rows.count() // p.block_items))
    for k in range(parts):
        for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect():
            yield r[0], r[1]
