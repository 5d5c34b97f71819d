from annalspark.operators import branches, graph
from tests_history import small_history


def test_branches(spark):
    symbols = spark.createDataFrame([("a", "BR", [1, 1, 0, 2]), ("b", "BR", [1, 2, 0, 4]), ("a", "SUB", [1, 1, 2, 1, 0, 2]), ("a", "TAG", [1, 1]), ("b", "GONE", [1, 9, 0, 2])], "path string, name string, rev array<bigint>")
    revs = spark.createDataFrame([("a", [1, 1], "Exp"), ("a", [1, 2], "Exp"), ("b", [1, 1], "Exp"), ("b", [1, 2], "Exp"), ("a", [1, 1, 2, 1], "Exp"), ("a", [1, 1, 4, 1], "dead")], "path string, rev array<bigint>, state string")
    entries = branches.discover(symbols, revs)
    got = {(r["name"], r["path"]): (list(r["point"]), r["state"], r["line"]) for r in entries.collect()}
    assert got == {("BR", "a"): ([1, 1], "live", ""), ("BR", "b"): ([1, 2], "live", ""), ("SUB", "a"): ([1, 1, 2, 1], "live", "BR"), ("GONE", "b"): ([1, 9], "missing", None)}
    parents = branches.wanted_parents(entries)
    imported, blocked = graph.branch_waves(parents)
    assert {(r["name"], r["parent"], r["wave"]) for r in imported.collect()} == {("BR", "", 1), ("SUB", "BR", 2), ("GONE", "", 1)} and blocked.count() == 0
    members = spark.createDataFrame([(0, "a", [1, 1]), (0, "b", [1, 1]), (1, "b", [1, 2]), (2, "a", [1, 2])], "idx int, path string, rev array<bigint>")
    plan = {r["branch"]: (r["position"], r["exact"]) for r in branches.plan(entries, members, parents, 3).collect()}
    assert plan == {"BR": (1, True)}
    assert {(r["line"], r["revisions"]) for r in branches.excluded(revs, symbols).collect()} == {("BR", 1), (None, 1)}
    nodes = spark.createDataFrame([(1, "p", [("svn:mergeinfo", b""), ("x", b"")]), (2, "q", [("svn:externals", b"")]), (3, "r", [])], "revision int, path string, props array<struct<k:string,v:binary>>")
    assert [(r["revision"], r["mergeinfo"], r["custom"]) for r in branches.property_losses(nodes).collect()] == [(1, True, True)]
    assert [r["path"] for r in branches.externals(nodes).collect()] == ["q"]


def test_import_stream(spark):
    from annalspark.sinks.fastimport import stream

    data = b"".join(stream(small_history(spark)))
    assert data.count(b"\nmark :") == 4 and b"M 100644 :1 a b\n" in data and b"from :3\n" in data
    assert b"author Alice <alice@example.com> 1000 +0000\n" in data and data.endswith(b"reset refs/heads/main\nfrom :4\n\n")
    assert data.index(b"root") < data.index(b"tip")


def test_discovery_takes_more_tasks_and_not_larger_ones(spark, monkeypatch):
    from pyspark.sql import functions as F

    from annalspark.operators import branches

    monkeypatch.setattr(branches, "_ROWS", 100)
    for n in (300, 1200):
        paths = spark.range(n).withColumnRenamed("id", "path")
        symbols = paths.select("path", F.lit("b").alias("name"), F.array(F.lit(1), F.lit(1), F.lit(0), F.lit(2)).cast("array<bigint>").alias("rev"))
        revisions = paths.select("path", F.array(F.lit(1), F.lit(1)).cast("array<bigint>").alias("rev"), F.lit("live").alias("state"))
        rows = branches.discover(symbols, revisions).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.min("state").alias("a"), F.max("line").alias("l")).collect()
        assert sum(r["n"] for r in rows) == n and max(r["n"] for r in rows) <= 100
        assert {(r["a"], r["l"]) for r in rows} == {("live", "")}
