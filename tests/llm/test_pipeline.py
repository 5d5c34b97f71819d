import collections

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.2, n), 5000))
    item = " ".join(f"q{i}" for i in range(30))
    clean = [prose(150) for _ in range(150)]
    toxic = [" ".join(w if rng.random() > 0.15 else rng.choice(["vile", "scummy"]) for w in prose(100).split()) for _ in range(60)]
    near = [c + " tail" for c in clean[:10]]
    leaked = [f"{prose(40)} {item} {prose(40)}" for _ in range(5)]
    private = [f"{prose(60)} mail a{i}@ex.org now {prose(10)}" for i in range(5)]
    texts = [*clean, *toxic, *near, *leaked, *private, "", None]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(150 <= i < 210)) for i in range(0, 210, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, seen = now.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = now
        assert k == 4 or now.columns == names
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in seen.items()}
    first = ids["quality classifier"]
    assert len(first & set(range(150))) > 145 and len(first & set(range(150, 210))) < 8
    assert ids["n-gram Jaccard join"] == first - set(range(210, 220))
    assert ids["benchmark decontamination"] == ids["n-gram Jaccard join"] - set(range(220, 225))
    masked = {r["doc_id"]: r for r in seen["PII"].collect()}
    for i in ids["PII"] & set(range(225, 230)):
        assert "[EMAIL]" in masked[i]["text"] and "@" not in masked[i]["text"] and masked[i]["n_chars"] == len(masked[i]["text"])
    packed = seen["best-fit packing"].collect()
    assert {r["doc_id"] for r in packed} == ids["PII"]
    fill = collections.Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 1843)


def test_stages_take_hard_tables(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, empty and long texts, clashing and differently written names, empty tables."""
    import corpus_pipeline

    long = " ".join(f"z{i}" for i in range(20_000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "one two three four five six", "en", None, 27), (1, "one two three four five six", "en", None, 27), (2, long, None, "s", None), (3, long + " end", "en", "s", 1), (None, "a b", "de", "s", 3), (4, " \n\t", "en", "s", 3)]
    docs = spark.createDataFrame([(*r, "x", 7, 1.5, "g") for r in rows], "Doc_ID long, Text string, lang string, source string, n_chars long, `set` string, `group` int, noise double, component_id string")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, ""), (2, "q w e r t y u i o p a s d f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            n = now.count()
            if k < 4:
                assert now.columns == docs.columns and n <= table.count(), name
                now.write.parquet(f"{tmp_path}/{table is docs}-{k}")
                now = spark.read.parquet(f"{tmp_path}/{table is docs}-{k}")
        assert (n > 0) == (table is docs)


def test_run_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert names["pipeline"] and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
