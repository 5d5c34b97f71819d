"""Changesets from a stream of per-file revisions.

State per (author, log) is the revisions not yet passed by the watermark and the open changeset.  Revisions are taken in
order of (date, path, rev) once the watermark has passed them, so the result is that of the batch operator whatever the
arrival order within the allowed delay; later ones are dropped by the watermark.  A changeset is given out when a gap, a
repeated path or the passing of time closes it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "author string, log string, earliest bigint, latest bigint, n_revs bigint, members array<string>"
STATE = "pending array<struct<date:bigint,path:string,rev:bigint>>, open array<struct<date:bigint,path:string,rev:bigint>>"


def changeset_stream(revs: DataFrame, window: int, delay: str) -> DataFrame:
    """revs: a stream of ts (event time), author, log, path, rev; append mode."""
    rows = revs.withWatermark("ts", delay).select(F.col("author").cast("string").alias("author"), F.col("log").cast("string").alias("log"), F.col("path").cast("string").alias("path"), F.col("rev").cast("bigint").alias("rev"), F.unix_timestamp("ts").alias("date"), "ts")

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, open_ = ([tuple(x) for x in part] for part in state.get) if state.exists else ([], [])
        for pdf in batches:
            pending += list(zip(pdf["date"], pdf["path"], pdf["rev"], strict=True))
        now = state.getCurrentWatermarkMs() // 1000
        pending = sorted((int(d), str(p), int(r)) for d, p, r in pending)
        closed = []
        while pending and pending[0][0] < now:
            row = pending.pop(0)
            if open_ and (row[0] - open_[-1][0] > window or row[1] in {x[1] for x in open_}):
                closed.append(open_)
                open_ = []
            open_.append(row)
        if open_ and not pending and open_[-1][0] + window < now:
            closed.append(open_)
            open_ = []
        if pending or open_:
            state.update((pending, open_))
            last = pending[0][0] if pending else open_[-1][0] + window
            state.setTimeoutTimestamp(max(last * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        for c in closed:
            yield pd.DataFrame([(key[0], key[1], c[0][0], c[-1][0], len(c), sorted(f"{p}@{r}" for _, p, r in c))], columns=["author", "log", "earliest", "latest", "n_revs", "members"])

    return rows.groupBy("author", "log").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
