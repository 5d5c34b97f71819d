"""Artifact files read and written by frames, against the container held in memory."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from annalspark.functions import canon
from annalspark.operators import frames
from annalspark.sources import artifact

MAGIC = b"history"




@pytest.mark.parametrize("seed", range(3))
def test_frames_equal_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 0, 1, rng.randrange(60), rng.randrange(60), rng.randrange(400)]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lengths)), "k int, n int").withColumn("Frame_", F.lit(1)).repartition(5)
    rows = frames.framed(df, ["k"], "n", 100).orderBy("k").collect()
    assert [r["rank"] for r in rows] == list(range(200)) and [r["start"] for r in rows] == [sum(lengths[:k]) for k in range(200)]
    sums: dict[int, int] = {}
    for r in rows:
        sums[r["frame"]] = sums.get(r["frame"], 0) + r["n"]
    assert [sums[k] for k in range(len(sums))] == list(canon.frame_lengths(lengths, 100))
    assert [r["frame"] for r in rows] == sorted(r["frame"] for r in rows)


def test_frames_of_edge_tables(spark):
    assert frames.framed(spark.createDataFrame([], "k int, n int"), ["k"], "n").count() == 0
    for lengths in ([0], [5], [0, 0, 0], [100, 100], [101], [1, 99, 0, 1], [1 << 40, 0, 3]):
        df = spark.createDataFrame(list(enumerate(lengths)), "k int, n long")
        rows = frames.framed(df, ["k"], "n", 100).orderBy("k").collect()
        assert rows[-1]["frame"] + 1 == len(list(canon.frame_lengths(lengths, 100)))


@pytest.mark.parametrize("seed", range(3))
def test_frames_pass_stretches_and_groups_of_them(spark, monkeypatch, seed):
    """Frames that cross stretches, stretches within a frame, and runs of empty contents at their borders."""
    monkeypatch.setattr(frames, "STRETCH", 4)
    monkeypatch.setattr(frames, "FAN", 2)
    rng = random.Random(seed)
    lengths = [[rng.choice([0, 0, 1, 30, rng.randrange(60), rng.randrange(300)]) for _ in range(75)], [rng.randrange(3) for _ in range(75)], [0] * 30 + [101] + [0] * 30 + [100, 0, 1]][seed]
    df = spark.createDataFrame(list(enumerate(lengths)), "k int, n int").repartition(3)
    rows = frames.framed(df, ["k"], "n", 100).orderBy("k").collect()
    sums: dict[int, int] = {}
    for r in rows:
        sums[r["frame"]] = sums.get(r["frame"], 0) + r["n"]
    assert [r["frame"] for r in rows] == sorted(r["frame"] for r in rows)
    assert [sums[k] for k in range(len(sums))] == list(canon.frame_lengths(lengths, 100))


def test_frames_take_few_jobs(spark):
    """The frames of a stretch are found where it lies: no rounds, each of which sends the results of its tasks to the driver."""
    df = spark.range(5000).select("id", (F.col("id") % 90).alias("n"))
    spark.sparkContext.setJobGroup("frames", "frames")
    try:
        frames.framed(df, ["id"], "n", 100).count()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("frames")) < 25
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_contents_are_written_in_runs_of_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifact, "PART_FRAMES", 2)
    rng = random.Random(4)
    blobs = sorted({_big(rng, n) for n in (700_000, 600_000, 1_500_000, 400_000, 900_000, 800_000, 20, 3)}, key=lambda b: hashlib.sha256(b).digest())
    metadata = _big(rng, 5_500_000)
    artifact.write(_contents(spark, blobs), str(tmp_path / "r.art"), MAGIC, metadata=metadata)
    assert (tmp_path / "r.art").read_bytes() == canon.container(MAGIC, (0, 3, 0), metadata, [(hashlib.sha256(b).digest(), b) for b in blobs])


def _contents(spark, blobs):
    rows = [(bytearray(hashlib.sha256(b).digest()), bytearray(b)) for b in blobs]
    return spark.createDataFrame(rows, "blob_id binary, content binary")


def _big(rng, n):
    return rng.randbytes(n // 2) + b"x" * (n - n // 2)


def test_a_file_is_the_container_and_comes_back(spark, tmp_path):
    rng = random.Random(1)
    blobs = sorted({b"", b"a", *(_big(rng, rng.randrange(1, 400_000)) for _ in range(30)), _big(rng, 3_000_000)}, key=lambda b: hashlib.sha256(b).digest())
    metadata = _big(rng, 2_500_000)
    path = str(tmp_path / "h.art")
    digest = artifact.write(_contents(spark, blobs).repartition(4), path, MAGIC, metadata=metadata)
    data = (tmp_path / "h.art").read_bytes()
    assert data == canon.container(MAGIC, (0, 3, 0), metadata, [(hashlib.sha256(b).digest(), b) for b in blobs])
    assert digest == data[len(MAGIC) + 4 : len(MAGIC) + 36]
    assert [p.name for p in tmp_path.iterdir()] == ["h.art"]
    artifact.checked(spark, path, MAGIC)
    back = artifact.read(spark, path, MAGIC, part_bytes=700_000)
    assert back.rdd.getNumPartitions() > 3
    rows = back.orderBy("rank").collect()
    assert [bytes(r["content"]) for r in rows] == blobs and [r["rank"] for r in rows] == list(range(len(blobs)))
    meta = artifact.read(spark, f"file://{path}", MAGIC, "metadata", 1_000_000).orderBy("frame").collect()
    assert b"".join(bytes(r["data"]) for r in meta) == metadata and [len(r["data"]) for r in meta] == canon.chunk_lengths(len(metadata))


def test_order_columns_rule_the_ranks(spark, tmp_path):
    contents = _contents(spark, [b"one", b"two", b"three"]).withColumn("path", F.concat(F.lit("p"), F.length("content").cast("string"), F.col("content").cast("string")))
    artifact.write(contents, str(tmp_path / "o.art"), MAGIC, order=["path"])
    assert [bytes(r["content"]) for r in artifact.read(spark, str(tmp_path / "o.art"), MAGIC).orderBy("rank").collect()] == [b"one", b"two", b"three"]


def test_an_empty_artifact(spark, tmp_path):
    path = str(tmp_path / "e.art")
    artifact.write(_contents(spark, []), path, MAGIC)
    assert (tmp_path / "e.art").read_bytes() == canon.container(MAGIC, (0, 3, 0), b"", [])
    assert artifact.read(spark, path, MAGIC).count() == 0 and artifact.read(spark, path, MAGIC, "metadata").count() == 0
    artifact.checked(spark, path, MAGIC)


def test_faults_are_refused(spark, tmp_path):
    blobs = sorted((b"a" * 700_000, b"b" * 800_000, b"c" * 10), key=lambda b: hashlib.sha256(b).digest())
    pairs = [(hashlib.sha256(b).digest(), b) for b in blobs]
    good = canon.container(MAGIC, (0, 3, 0), b"meta", pairs)
    swapped = canon.container(MAGIC, (0, 3, 0), b"meta", [(pairs[1][0], blobs[0]), *pairs[1:]])
    at = len(MAGIC) + 4
    faults = {
        "not an artifact": b"x" + good[1:],
        "unknown artifact format": MAGIC + b"\x07" + good[len(MAGIC) + 1 :],
        "is not read": canon.container(MAGIC, (0, 9, 0), b"meta", pairs),
        "packing rule|ends too soon|does not end": good[:-3],
        "packing rule": good + b"z",
        "not its id": swapped,
    }
    for text, data in faults.items():
        (tmp_path / "f.art").write_bytes(data)
        with pytest.raises(Exception, match=text):
            artifact.read(spark, str(tmp_path / "f.art"), MAGIC).collect()
    (tmp_path / "d.art").write_bytes(good[:at] + bytes(32) + good[at + 32 :])
    with pytest.raises(canon.NonCanonical, match="digest"):
        artifact.checked(spark, str(tmp_path / "d.art"), MAGIC)


def test_a_failed_write_leaves_the_file_as_it_was(spark, tmp_path):
    path = str(tmp_path / "k.art")
    artifact.write(_contents(spark, [b"old"]), path, MAGIC)
    before = (tmp_path / "k.art").read_bytes()
    broken = _contents(spark, [b"new", b"newer"]).withColumn("content", F.when(F.length("content") > 3, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        artifact.write(broken, path, MAGIC)
    assert (tmp_path / "k.art").read_bytes() == before


def test_reading_holds_a_frame_at_a_time(spark, tmp_path):
    """A file of 96 MB whose reader, with batches of 8 MB, never holds a large part of it."""
    import tracemalloc

    rng = random.Random(2)
    block = rng.randbytes(1 << 20)
    blobs = sorted((block[:-4] + k.to_bytes(4, "big") for k in range(96)), key=lambda b: hashlib.sha256(b).digest())
    path = tmp_path / "b.art"
    path.write_bytes(canon.container(MAGIC, (0, 3, 0), b"", [(hashlib.sha256(b).digest(), b) for b in blobs], pack=lambda raw: (0, raw)))
    reader = artifact.Reader({"path": str(path), "magic": MAGIC.hex()})
    tracemalloc.start()
    (first, *_) = slices = reader.partitions()
    assert len(slices) == 2 and tracemalloc.get_traced_memory()[1] < 4 << 20
    n = sum(batch.num_rows for part in slices for batch in reader.read(part))
    assert n == 96 and tracemalloc.get_traced_memory()[1] < 40 << 20
    (row,) = next(iter(artifact.Reader({"path": str(path), "magic": MAGIC.hex(), "table": "digest"}).read(first))).to_pylist()
    assert row["stated"] == row["found"] and row["blobs"] == 96
    tracemalloc.stop()
