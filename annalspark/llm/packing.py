"""Packs documents into sequences of at most `capacity` tokens.

A document's tokens end with one separator (id 0).  Only documents longer than the capacity are cut, into pieces of
exactly the capacity; the last piece may be shorter.  Full pieces are sequences of their own.  The others are dealt by a
hash into groups of about `group_rows` pieces; each group is packed best fit decreasing and then improved by local
search: the emptiest sequences give their pieces away by moving a piece, exchanging one for one, or two for one, always
raising the sum of squared fills, until no further sequence can be emptied or the lower bound is met.  A group wastes at
most a fraction of a few sequences, so groups cost a share that falls as one over `group_rows`.

Cases: a null text is an empty one (one piece: the separator); null ids and repeated rows are packed like any other
row; empty tables give no rows; extra columns are ignored; very long texts give many pieces.  Ties between equally long
pieces go by their order in the group, and which group a piece is in may change with the table's files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Stages, dealt

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = tokens.SEQUENCE, with_ids: bool = False, cached: int = tokens.CACHED) -> DataFrame:
    """Pieces of every document; with_ids adds their ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary, cached).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += b"\0\0\0\0"
                    for k in range(0, len(ids), 4 * capacity):
                        cut = ids[k : k + 4 * capacity]
                        rows.append((doc_id, k // (4 * capacity), k // 4, len(cut) // 4, zlib.crc32(cut), cut))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if with_ids else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing; bins of item numbers."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fits = open_gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
            bins[b].append(item)
        else:
            gap, b = capacity, len(bins)
            bins.append([item])
        if gap > size:
            by_gap[gap - size].append(b)
            open_gaps |= 1 << (gap - size)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int, patience: int = 64) -> list[list[int]]:
    """Empties sequences by moves, one-for-one and two-for-one exchanges among underfull ones.

    Stops at the lower bound, or after `patience` sequences in a row that could not be emptied.
    """
    bound = -(-int(lengths.sum()) // capacity)
    left = len(bins) - bound
    if left <= 0:
        return bins
    place = np.empty(len(lengths), np.int64)
    for b, items in enumerate(bins):
        place[items] = b
    gap = np.array([capacity - int(lengths[items].sum()) for items in bins])
    alive = gap > 0
    pool = np.flatnonzero(alive[place])  # items of underfull bins; full bins cannot take part
    size = lengths[pool]
    failed = 0
    tried = np.zeros(len(bins), bool)
    gone: set[int] = set()

    def put(item: int, to: int) -> None:
        gap[place[item]] += lengths[item]
        gap[to] -= lengths[item]
        bins[place[item]].remove(item)
        bins[to].append(item)
        place[item] = to

    while left > 0 and failed < patience:
        candidates = np.flatnonzero(alive & ~tried)
        if not len(candidates):
            break
        victim = int(candidates[np.argmax(gap[candidates])])
        tried[victim] = True
        moved = False
        while bins[victim]:
            own = sorted(bins[victim], key=lambda i: -lengths[i])
            done = False
            for x in own:  # move into the tightest gap
                # a step raises the sum of squares exactly if the receiver ends up fuller than the giver was
                can = np.flatnonzero(alive & (gap >= lengths[x]) & (lengths[x] - gap > -gap[victim]))
                can = can[can != victim]
                if len(can):
                    to = int(can[np.argmin(gap[can])])
                    put(x, to)
                    done = True
                    break
            if done:
                moved = True
                continue
            other = place[pool] != victim
            room = np.where(other, gap[place[pool]], -1)
            for take in [[x] for x in own] + [[own[i], own[j]] for i in range(min(len(own), 12)) for j in range(i + 1, min(len(own), 12))]:
                gain = int(lengths[take].sum()) - size
                ok = (gain > 0) & (gain <= room) & (gain - room > -gap[victim]) & other
                if ok.any():
                    k = int(np.argmax(np.where(ok, gain, -1)))
                    y, to = int(pool[k]), int(place[pool[k]])
                    put(y, victim)
                    for x in take:
                        put(x, to)
                    done = True
                    break
            if not done:
                break
            moved = True
        if bins[victim]:
            failed += 1
            if moved:  # others may find room now; every step raises the sum of squares, so this ends
                tried[:] = False
                tried[[victim, *gone]] = True
        else:
            gone.add(victim)
            alive[victim] = False
            left -= 1
            failed = 0
            tried[:] = False
            tried[list(gone)] = True
    return [b for b in bins if b]


def pack_group(group: int, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece", "length", "ids_crc32"], kind="stable", na_position="last").reset_index(drop=True)
    length = rows["length"].to_numpy(np.int64)
    sequence, offset = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
    full, part = np.flatnonzero(length >= capacity), np.flatnonzero(length < capacity)
    sequence[full] = np.arange(len(full))
    bins = improve(best_fit(length[part], capacity), length[part], capacity) if len(part) else []
    for b, items in enumerate(bins):
        at = part[items]
        sequence[at] = len(full) + b
        offset[at] = np.concatenate([[0], np.cumsum(length[at])[:-1]])
    return rows.assign(sequence_id=(np.int64(group) << 40) + sequence, offset=offset)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = tokens.SEQUENCE, group_rows: int = 50_000, cached: int = tokens.CACHED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    stages = Stages(docs.sparkSession, "packing")
    cut = pieces(docs, vocabulary or tokens.default_vocabulary(), capacity, cached=cached)
    # numbered before they are dealt: rows that are equal in all columns, however many, spread over the groups too
    cut = stages.write(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // group_rows))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pack_group(int(key[0]), rows.drop(columns=["group", "row"]), capacity)

    numbered = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)))
    return dealt(numbered, groups, "group").groupBy("group").applyInPandas(run, PIECES + ", sequence_id long, offset long")


def waste(lengths: np.ndarray, n_sequences: int, capacity: int) -> float:
    """Share of the sequences' room that stays empty."""
    return 1 - float(np.sum(lengths)) / (n_sequences * capacity) if n_sequences else 0.0
