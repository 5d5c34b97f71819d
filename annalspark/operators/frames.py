"""Order and packing of contents: numbers and offsets over a whole order, and greedy frames, without a task that sees all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import written

LIMIT = 1 << 20
#: Rows whose frames one task finds at a time, and stretches (or groups of them) that one task passes through.
STRETCH, FAN = 1 << 18, 16


def running(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """df with, for each name, the sum of its expression over all rows before in the order, which must tell rows apart.

    Rows are dealt to ranges of the order; a range adds the sums of the ranges before it, of which there is one row each.
    """
    ranged = df.repartitionByRange(*order).select("*", *(c.cast("long").alias(f"_{n}") for n, c in sums.items())).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "running")
    parts = ranged.groupBy("_range").agg(*(F.sum(f"_{n}").alias(f"_{n}_all") for n in sums))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_range", *(F.coalesce(F.sum(f"_{n}_all").over(before), F.lit(0)).alias(f"_{n}_before") for n in sums))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(parts), "_range")  # one row a range
    return out.select(*df.columns, *((F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) + F.col(f"_{n}_before")).alias(n) for n in sums))


def _hops(start: np.ndarray, end: int, limit: int) -> np.ndarray:
    """The row that opens the frame after that of each row, if it opened one; rows beyond the stretch: its number of rows."""
    n, reach = len(start), start + limit
    to = np.maximum(np.searchsorted(start, reach, "right") - 1, np.arange(n) + 1)
    return np.where(reach >= end, n, to)


def _passage(start: np.ndarray, end: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How frames pass a stretch of rows: by the reach of the frame that is open before it (its start and the limit), the reach behind it and the frames opened in it.

    A reach of at[i] or more, and less than at[i + 1], leaves the stretch as to[i] after opened[i] frames; one up to
    `end` or beyond it takes in all rows and stays.  at[0] is below all: the row before is longer than the limit.
    """
    n = len(start)
    last, opened = np.append(_hops(start, end, limit), n), np.append(np.ones(n, np.int64), 0)
    exits = np.append(start + limit, 0)
    final = np.where(last < n, -1, np.arange(n + 1))  # the frame's opening row whose reach leaves the stretch
    while (final < 0).any():
        after = last[last]
        final, opened = np.where(final < 0, np.where(final[last] >= 0, final[last], -1), final), opened + np.where(final < 0, opened[last], 0)
        last = after
    some = np.flatnonzero(np.append(start[1:] > start[:-1], True) & (start < end) & (start <= start[0] + limit))
    rows = np.append(0, some)
    return np.append(-1, start[some]), exits[final[rows]], opened[rows]


def _passed(reach: np.ndarray, at: np.ndarray, to: np.ndarray, opened: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.maximum(np.searchsorted(at, reach, "right") - 1, 0)
    stays = reach >= end
    return np.where(stays, reach, to[i]), np.where(stays, 0, opened[i])


_PASSAGES = "stretch long, low long, end long, at array<long>, to array<long>, opened array<long>"


def _passages(rows: pa.Table) -> list[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of _PASSAGES in order."""
    lists = [[x.values.to_numpy() for x in rows[c]] for c in ("at", "to", "opened")]
    return sorted(zip(*(rows[c].to_pylist() for c in ("stretch", "low", "end")), *lists, strict=True), key=lambda r: r[0])


def _row(stretch: int, low: int, end: int, at: np.ndarray, to: np.ndarray, opened: np.ndarray) -> pa.Table:
    return pa.table({"stretch": [stretch], "low": [low], "end": [end], **{k: pa.array([v], pa.list_(pa.int64())) for k, v in (("at", at), ("to", to), ("opened", opened))}})


def _entries(points: DataFrame, n: int, limit: int) -> DataFrame:
    """stretch, reach, before: for each stretch of rows the reach of the frame that is open before it (-1: none), and the frames before it.

    points: stretch, start, stop.  Stretches are passed one after another by what is known of each, FAN of them a task;
    more of them are put together to one first, which keeps what is known of the rows within the limit from its beginning.
    """
    fan = FAN

    def passage(rows: pa.Table) -> pa.Table:
        start, end = np.sort(rows["start"].to_numpy()), int(rows["stop"].to_numpy().max())
        return _row(rows["stretch"][0].as_py(), int(start[0]), end, *_passage(start, end, limit))

    def together(rows: pa.Table) -> pa.Table:
        (stretch, low, end, at, to, opened), *others = _passages(rows)
        for _, _, stop, next_at, next_to, next_opened in others:
            to, more = _passed(to, next_at, next_to, next_opened, stop)
            own = (next_at >= max(end, 0)) & (next_at <= low + limit)
            at, to, opened, end = np.append(at, next_at[own]), np.append(to, next_to[own]), np.append(opened + more, next_opened[own]), stop
        return _row(stretch // fan, low, end, at, to, opened)

    def each(key: tuple, known: pa.Table, entered: pa.Table) -> pa.Table:
        reach, before = entered["reach"].to_numpy()[:1], entered["before"].to_numpy()[:1]
        out = []
        for stretch, _, end, at, to, opened in _passages(known):
            out.append((stretch, int(reach[0]), int(before[0])))
            reach, more = _passed(reach, at, to, opened, end)
            before = before + more
        columns = zip(*out, strict=True) if out else [()] * 3  # a table without rows has no stretches
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["stretch", "reach", "before"])

    levels, size = [written(points.groupBy("stretch").applyInArrow(passage, _PASSAGES), "passages")], -(-n // STRETCH)
    while size > fan:
        levels.append(written(levels[-1].groupBy(F.floor(F.col("stretch") / fan)).applyInArrow(together, _PASSAGES), "passages"))
        size = -(-size // fan)
    found = points.sparkSession.createDataFrame([(0, -1, 0)], "stretch long, reach long, before long")
    for known in reversed(levels):
        found = known.groupBy(F.floor(F.col("stretch") / fan).alias("group")).cogroup(found.groupBy(F.col("stretch").alias("group"))).applyInArrow(each, "stretch long, reach long, before long")
    return written(found, "entries")


def framed(df: DataFrame, order: list[str], length: str, limit: int = LIMIT) -> DataFrame:
    """df with rank (from 0), start (bytes before) and frame (from 0).

    A frame takes rows in order while they stay within the limit; a longer one stands alone.  Where a stretch of rows is
    entered is known from how frames pass the stretches before it; each then finds its own frames.
    """
    rows = written(running(df, order, rank=F.lit(1), start=F.col(length)), "ranked")
    points = rows.select(F.floor(F.col("rank") / STRETCH).alias("stretch"), "rank", "start", (F.col("start") + F.col(length)).alias("stop"))
    entries = _entries(points.drop("rank"), rows.count(), limit)

    def numbered(stretch: pa.Table) -> pa.Table:
        stretch = stretch.sort_by("rank")
        start, end, reach = stretch["start"].to_numpy(), int(stretch["stop"].to_numpy().max()), stretch["reach"][0].as_py()
        hops, opens = _hops(start, end, limit).tolist(), np.zeros(len(start), np.int64)
        i = len(start) if reach >= end else max(int(np.searchsorted(start, reach, "right")) - 1, 0)
        while i < len(start):
            opens[i] = 1
            i = hops[i]
        return pa.table([stretch["rank"], pa.array(np.cumsum(opens) + (stretch["before"][0].as_py() - 1))], names=["rank", "frame"])

    frames = points.join(F.broadcast(entries), "stretch").groupBy("stretch").applyInArrow(numbered, "rank long, frame long")  # one entry a stretch
    return rows.join(frames, "rank").select(*df.columns, "rank", "start", "frame")
