import datetime

import numpy as np

from annalspark.operators import cluster
from annalspark.streaming.changesets import changeset_stream


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(seconds=int(s)), f"u{rng.integers(3)}", f"m{rng.integers(2)}", f"p{rng.integers(4)}", i) for i, s in enumerate(np.sort(rng.integers(0, 20_000, 300)))]
    late = [(start + datetime.timedelta(days=d), f"u{u}", f"m{m}", "end", 10_000 + 10 * d + u) for d in (3, 6) for u in range(3) for m in range(2)]
    schema = "ts timestamp, author string, log string, path string, rev bigint"
    order = [*rng.permutation(100), *(100 + rng.permutation(200))]
    for k, part in enumerate(([rows[i] for i in order[:100]], [rows[i] for i in order[100:]], late[:6], late[6:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = changeset_stream(files, 180, "1 day").writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        got = {(r["author"], r["log"], tuple(r["members"])) for r in spark.table("made").collect()}
    finally:
        query.stop()
    batch = spark.createDataFrame(rows, schema).selectExpr("author", "log", "path", "rev", "unix_timestamp(ts) as date")
    want = {}
    for r in cluster.reconstruct(batch, 180).collect():
        want.setdefault((r["author"], r["log"], r["cluster"]), []).append(f"{r['path']}@{r['rev']}")
    assert {(a, m, tuple(sorted(x))) for (a, m, _), x in want.items()} <= got
    assert sum(not any("end" in x for x in g[2]) for g in got) == len(want)
