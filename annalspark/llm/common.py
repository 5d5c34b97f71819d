"""Stage tables, size measures and exact distributed selection shared by the operators.

Stages are written as Parquet below the folder named by `spark.checkpoint.dir`, which every executor shares; reading
them back cuts the lineage, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


#: Settings of stage writes: shuffle files go when the write ends, as its table has what they held; batches that go to
#: Python are smaller than usual, as texts may be long.
_STAGE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextlib.contextmanager
def _stage_settings(spark: SparkSession) -> Iterator[None]:
    """The settings hold for one write; other executions keep theirs."""
    was = {}
    for key, value in _STAGE_CONF.items():
        with contextlib.suppress(Exception):  # a version without the setting
            was[key] = spark.conf.get(key)
            spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


class Stages:
    """Tables of one operator call.  Each is written once; `drop` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        with _stage_settings(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


    def retain(self, *names: str) -> None:
        """Drops all tables but the named ones."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at)
        for found in path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
            if found.getPath().getName() not in names:
                self.drop(found.getPath().getName())


def text_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of text."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()
    return int(n), int(size)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column; names are alike whatever their case, as in Spark."""
    return [c.lower() for c in df.columns].index(name.lower())


def dealt(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Dealt by the keys to a task a group, where the session would put several groups into a task."""
    return df.repartition(groups, *keys) if groups > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def kth_largest(df: DataFrame, col: str, k: int, buckets: int = 4096) -> float:
    """The k-th largest value of a finite DOUBLE column, exactly; -inf if there are fewer than k rows.

    Each round counts rows per bucket of the current interval (a bounded result) and goes into one bucket.
    """
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k > n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    while True:
        step = (hi - lo) / buckets
        if not step or lo + step <= lo or hi - step >= hi:
            inside = df.filter(F.col(col).between(lo, hi)).groupBy(col).count().orderBy(F.col(col).desc()).limit(buckets * 4).collect()
            for value, many in inside:
                k -= many
                if k <= 0:
                    return value
            return lo
        at = F.least(F.greatest(F.floor((F.col(col) - lo) / step), F.lit(0)), F.lit(buckets - 1))
        counts = {r[0]: (r[1], r[2], r[3]) for r in df.filter(F.col(col).between(lo, hi)).groupBy(at.alias("b")).agg(F.count(F.lit(1)), F.min(col), F.max(col)).collect()}
        for b in sorted(counts, reverse=True):
            many, low, high = counts[b]
            if k <= many:
                if low == high:
                    return low
                lo, hi = low, high
                break
            k -= many


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()
