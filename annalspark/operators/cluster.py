"""Changesets from per-file revisions: sessions by author and log, order fix, overlap and confidence.

Input rows have author, log, path, rev, date (seconds) and whatever else they carry; `rev` may be an integer or an
array of integers.  Everything is windows and folds partitioned by (author, log) or by path: a path or an author with
very many revisions is one window partition, which Spark sorts externally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rev_text(rev: Column, is_array: bool) -> Column:
    return F.array_join(F.transform(rev, lambda x: x.cast("string")), ".") if is_array else rev.cast("string")


def _path_at_rev(df: DataFrame) -> Column:
    return F.concat(F.col("path").cast("string"), F.lit("@"), rev_text(F.col("rev"), df.schema["rev"].dataType.typeName() == "array"))


def gap_runs(revs: DataFrame, window: int) -> DataFrame:
    """Adds `run`: rows of one (author, log) in order of (date, path, rev), cut where the gap exceeds the window."""
    order = W.partitionBy("author", "log").orderBy("date", "path", "rev")
    gap = F.col("date") - F.lag("date").over(order)
    return revs.withColumn("opens", F.when(gap.isNull() | (gap > window), 1).otherwise(0)).withColumn("run", F.sum("opens").over(order)).drop("opens")


def reconstruct(revs: DataFrame, window: int) -> DataFrame:
    """Adds `cluster`, a number within (author, log): gaps cut, and so does a path that the open cluster already has.

    Where a cluster opens depends on where the last one did, so the starts of each gap run are found by a fold over
    (row, previous row of the same path), which keeps nothing but the last start and the list of starts.
    """
    group = ["author", "log"]
    order = W.partitionBy(*group).orderBy("date", "path", "rev")
    rows = gap_runs(revs, window).withColumn("rn", F.row_number().over(order))
    rows = rows.withColumn("before", F.lag("rn").over(W.partitionBy(*group, "run", "path").orderBy("rn")))
    # only rows with an earlier one of their path can open a cluster, besides the first of each run
    repeats = rows.filter("before is not null").groupBy(*group, "run").agg(F.array_sort(F.collect_list(F.struct("rn", "before"))).alias("steps"))
    first = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("open"), first.alias("cuts"))
    fold = F.aggregate(
        "steps", start,
        lambda s, x: F.when(x["before"] >= s["open"], F.struct(x["rn"].alias("open"), F.concat(s["cuts"], F.array(x["rn"])).alias("cuts"))).otherwise(s),
        lambda s: s["cuts"],
    )
    # the cuts stand before their rows in the same line, so that no join is needed
    cuts = repeats.select(*group, "run", F.explode(fold).alias("rn"), F.lit(1).alias("cut"))
    line = W.partitionBy(*group).orderBy("rn", F.desc("cut"))
    marked = rows.withColumn("cut", F.lit(0)).unionByName(cuts, allowMissingColumns=True)
    opens = F.when((F.col("cut") == 1) | (F.col("run") != F.coalesce(F.lag("run").over(line), F.lit(0))), 1).otherwise(0)
    return marked.withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(line)).filter("cut = 0").drop("run", "rn", "before", "cut", "opens")


def summarise(clusters: DataFrame) -> DataFrame:
    """One row per cluster: span, paths, revisions, and its order key (latest date, smallest path@rev)."""
    return clusters.withColumn("at", _path_at_rev(clusters)).groupBy("author", "log", "cluster").agg(
        F.min("date").alias("earliest"), F.max("date").alias("latest"), F.count_distinct("path").alias("n_paths"), F.count(F.lit(1)).alias("n_revs"), F.min("at").alias("min_key")
    )


def identities(clusters: DataFrame) -> DataFrame:
    """Identity text of each cluster: its sorted path@rev, joined by line feeds."""
    return clusters.withColumn("at", _path_at_rev(clusters)).groupBy("author", "log", "cluster").agg(F.array_join(F.array_sort(F.collect_list("at")), "\n").alias("identity"))


def misplaced(placed: DataFrame) -> DataFrame:
    """Adds `misplaced` and `anchor`: a revision stands before a lower-numbered one of its path.

    Rows have path, rev and an ordered position `pos`; the anchor is the largest position of lower revisions.
    """
    before = F.max("pos").over(W.partitionBy("path").orderBy("rev").rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn("anchor", before).withColumn("misplaced", F.coalesce(F.col("pos") < before, F.lit(False)))


def fix_order(clusters: DataFrame) -> DataFrame:
    """Changeset key, order and `order_split` of every revision, misplaced ones cut out behind their anchors."""
    group = ["author", "log", "cluster"]
    key = summarise(clusters).select(*group, F.struct(F.col("latest"), F.col("min_key")).alias("pos"))
    rows = misplaced(clusters.join(key, group))
    single = F.struct(F.col("path").cast("string").alias("path"), F.col("rev"))
    none = F.lit(None).cast(clusters.select(single.alias("s")).schema["s"].dataType)
    at = F.when(F.col("misplaced"), F.struct(F.col("anchor").alias("pos"), F.lit(1).alias("after"), single.alias("single"))).otherwise(F.struct(F.col("pos"), F.lit(0).alias("after"), none.alias("single")))
    return rows.withColumn("changeset", at).withColumn("order_split", F.col("misplaced")).drop("pos", "anchor", "misplaced")


def overlap_counts(touches: DataFrame, window: int) -> DataFrame:
    """id, overlap: how many paths of a changeset another one touches within the window of its range.

    touches: id, path, earliest, latest (one row per changeset and path, earliest <= latest).  On one path another
    changeset meets [earliest - w, latest + w] exactly if #{earliest_j <= hi} - #{latest_j < lo} >= 2, as a changeset
    meets itself; both counts are running sums over the path's time line, so a path touched by everything costs a sort.
    """
    t = touches.select("id", "path", (F.col("earliest") - window).alias("lo"), (F.col("latest") + window).alias("hi"), "earliest", "latest")
    events = t.select(
        "id", "path",
        F.explode(F.array(
            F.struct(F.col("lo").alias("t"), F.lit(0).alias("rank"), F.lit(0).alias("begun"), F.lit(0).alias("over")),
            F.struct(F.col("earliest").alias("t"), F.lit(1).alias("rank"), F.lit(1).alias("begun"), F.lit(0).alias("over")),
            F.struct(F.col("hi").alias("t"), F.lit(2).alias("rank"), F.lit(0).alias("begun"), F.lit(0).alias("over")),
            F.struct(F.col("latest").alias("t"), F.lit(3).alias("rank"), F.lit(0).alias("begun"), F.lit(1).alias("over")),
        )).alias("e"),
    ).select("id", "path", "e.*")
    line = W.partitionBy("path").orderBy("t", "rank").rangeBetween(W.unboundedPreceding, W.currentRow)
    run = events.withColumn("n_begun", F.sum("begun").over(line)).withColumn("n_over", F.sum("over").over(line)).filter("rank in (0, 2)")
    per = run.groupBy("id", "path").agg((F.max(F.when(F.col("rank") == 2, F.col("n_begun"))) - F.max(F.when(F.col("rank") == 0, F.col("n_over")))).alias("met"))
    return per.groupBy("id").agg(F.sum(F.when(F.col("met") >= 2, 1).otherwise(0)).alias("overlap"))


def overlap_counts_naive(touches: DataFrame, window: int) -> DataFrame:
    """The same by a self-join, for tests and ranges that are not well formed."""
    a, b = touches.alias("a"), touches.alias("b")
    met = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.id") != F.col("b.id")) & (F.col("b.earliest") <= F.col("a.latest") + window) & (F.col("b.latest") >= F.col("a.earliest") - window), "left_semi")
    hits = met.groupBy("id").agg(F.count_distinct("path").alias("overlap"))
    return touches.select("id").distinct().join(hits, "id", "left").select("id", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def time_score(span: Column, window: int) -> Column:
    """100 for no span, falling to 0 at the window; huge spans saturate."""
    share = F.call_function("div", F.least(span, F.lit(92233720368547758)) * 100, F.lit(max(window, 1)).cast("bigint"))
    return F.when(span <= 0, F.lit(100).cast("bigint")).otherwise(100 - F.least(F.lit(100).cast("bigint"), share))


def confidence(span: Column, window: int, n_paths: Column, overlap: Column, order_split: Column | None = None) -> Column:
    """floor(time score * (2 paths - overlap) / (2 paths)) within 0..100, at most 50 for split-off revisions."""
    n = F.greatest(n_paths.cast("bigint"), F.lit(1).cast("bigint"))
    value = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(100).cast("bigint"), F.call_function("div", time_score(span, window) * (2 * n - overlap), 2 * n)))
    return value if order_split is None else F.when(order_split, F.least(value, F.lit(50).cast("bigint"))).otherwise(value)


def changesets(revs: DataFrame, window: int = 180) -> DataFrame:
    """Changesets with members: author, log, changeset (order key), earliest, latest, n_paths, n_revs, overlap,
    order_split, confidence and members (array of path, rev)."""
    rows = fix_order(reconstruct(revs, window))
    made = rows.groupBy("author", "log", "cluster", "changeset", "order_split").agg(
        F.min("date").alias("earliest"), F.max("date").alias("latest"), F.count_distinct("path").alias("n_paths"), F.count(F.lit(1)).alias("n_revs"), F.array_sort(F.collect_list(F.struct("path", "rev"))).alias("members")
    )
    made = made.withColumn("id", F.sha2(F.to_json(F.struct("author", "log", "changeset")), 256))
    touches = made.select("id", "earliest", "latest", F.explode(F.array_distinct(F.col("members.path"))).alias("path"))
    return made.join(overlap_counts(touches, window), "id").withColumn("confidence", confidence(F.col("latest") - F.col("earliest"), window, F.col("n_paths"), F.col("overlap"), F.col("order_split")))


def check_floor(made: DataFrame, floor: int = 50) -> DataFrame:
    """Refuses an import of which no changeset reaches the floor; passes an empty one and any other on."""
    best = made.agg(F.max("confidence")).first()[0]
    if best is not None and best < floor:
        raise ValueError(f"no reconstructed changeset reached the confidence floor ({floor})")
    return made
