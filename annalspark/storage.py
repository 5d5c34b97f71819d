"""The shared folder for tables that cut long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in a local session that names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = Path(tempfile.gettempdir()) / f"annalspark-{os.getuid()}"
    own.mkdir(parents=True, exist_ok=True)
    return f"file://{own}"


class Rounds:
    """Tables of a loop, each written once below the shared folder, so that lineage stays short; old ones can be dropped."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.at}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self, n: int) -> None:
        """Drops all tables but the last n."""
        jvm = self.spark.sparkContext._jvm
        for k in range(1, self.made - n + 1):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{k}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once below the shared folder and read from there."""
    return Rounds(df.sparkSession, name).write(df)


def spread(df: DataFrame, *keys: str, rows: int = 1 << 17) -> DataFrame:
    """The table dealt by keys to as many partitions as hold about `rows` rows each, so that a task's memory does not grow with the table.

    A number given by hand is one that adaptive execution does not merge, as it does partitions that are small when
    compressed.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def swap(spark: SparkSession, path: str, text: str) -> None:
    """Gives a one-line file new text in one step: readers find the old line or the new one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    to, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = new.getFileSystem(conf).create(new, True)
    out.write(text.encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else to.getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(files.makeQualified(new), files.makeQualified(to), options)
