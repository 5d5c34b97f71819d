"""A history is written all or nothing."""

import hashlib

import pytest
from pyspark.sql import functions as F

from annalspark.history import History
from annalspark.storage import swap


def _blobs(*texts):
    return [(bytearray(hashlib.sha256(t).digest()), len(t), bytearray(t)) for t in texts]


def test_a_failed_write_leaves_the_old_history(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    History.of(spark, blobs=_blobs(b"old")).write(path)
    broken = History.of(spark, flags=[("kind", "what", 1, "reason")]).replace(transforms=spark.range(1).select(F.raise_error(F.lit("lost")).cast("int").alias("step"), F.lit("n").alias("name"), F.lit("v").alias("version"), F.create_map().cast("map<string,string>").alias("params")))
    with pytest.raises(Exception, match="lost"):
        broken.write(path)
    again = History.read(spark, path)
    assert [bytes(r["content"]) for r in again.blobs.collect()] == [b"old"] and again.flags.count() == 0
    History.of(spark, blobs=_blobs(b"new", b"newer")).write(path)
    assert sorted(bytes(r["content"]) for r in History.read(spark, path).blobs.collect()) == [b"new", b"newer"]
    assert sorted(bytes(r["content"]) for r in again.blobs.collect()) == [b"old"]  # readers of the version before are not disturbed


def test_swap_replaces_a_line(spark, tmp_path):
    for text in ("one", "two", "three"):
        swap(spark, f"{tmp_path}/line", text)
        assert (tmp_path / "line").read_text() == text
        assert spark.read.text(f"{tmp_path}/line").first()[0] == text


def test_spread_keeps_the_rows_of_a_task_when_the_table_grows(spark):
    from pyspark.sql import functions as F

    from annalspark.plans.history_queries import QUERIES
    from annalspark.storage import spread

    for n in (1000, 8000):
        sizes = [r["n"] for r in spread(spark.range(n), "id", rows=100).groupBy("id").count().groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) < 200
    plan = QUERIES["branch_cut_sweep"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
