"""Branches, tags and other names: tips, targets, cut points, majority lines, reconstructed roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def branch_heads(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes without a child on their own branch.  nodes: node, branch, ...; parents: node, parent."""
    branch = nodes.select("node", "branch")
    same = parents.join(branch, "node").join(branch.select(F.col("node").alias("parent"), F.col("branch").alias("above")), "parent").filter(F.col("branch") == F.col("above"))
    return nodes.join(same.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def branch_tips(heads: DataFrame) -> DataFrame:
    """branch, tip, open: the last open head, else the last head.  heads: node, branch, rev, open (boolean)."""
    best = heads.groupBy("branch").agg(F.max(F.struct(F.col("open").alias("open"), F.col("rev").alias("rev"), F.col("node").alias("node"))).alias("b"))
    return best.select("branch", F.col("b.node").alias("tip"), F.col("b.open").alias("open"))


def collect_symbols(entries: DataFrame) -> DataFrame:
    """name, is_branch, entries: name, path, rev, branch_like gathered; a name is a branch if any of its entries is."""
    return entries.groupBy("name").agg(F.bool_or("branch_like").alias("is_branch"), F.array_sort(F.collect_list(F.struct("path", "rev"))).alias("entries"))


def symbol_targets(symbols: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name, atom, date of the latest atom among a symbol's (path, rev) pairs, and the pairs that no atom holds.

    Ties on the date go to the smallest (path, rev).
    """
    met = symbols.join(placed, ["path", "rev"])
    order = F.struct(-F.col("date"), F.col("path"), F.col("rev"))
    best = met.groupBy("name").agg(F.min_by(F.struct("atom", "date"), order).alias("b")).select("name", "b.atom", "b.date")
    return best, symbols.join(placed, ["path", "rev"], "left_anti")


def majority_line(points: DataFrame) -> DataFrame:
    """branch, line, n: the line with most live points; the main line ('') and then lower names win ties."""
    n = points.filter("line is not null").groupBy("branch", "line").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("branch").agg(F.max(F.struct("n")).alias("m")).select("branch", F.col("m.n").alias("n")).join(n, ["branch", "n"]).groupBy("branch", "n").agg(F.min("line").alias("line")).select("branch", "line", "n")


def cut_points(runs: DataFrame, line_len: int) -> DataFrame:
    """branch, position, exact, covered: where a branch leaves its parent line.

    runs: branch, in, out: a file is at its branch point from position `in` up to before `out`.  Exact is the earliest
    position that covers every file; else the earliest with most files covered, by a sweep over the ends of the runs.
    """
    ends = runs.groupBy("branch").agg(F.max("in").alias("max_in"), F.min("out").alias("min_out"), F.count(F.lit(1)).alias("files"))
    exact = ends.filter("max_in < min_out").select("branch", F.col("max_in").alias("position"), F.lit(True).alias("exact"), F.col("files").alias("covered"))
    open_ = runs.join(ends.filter("max_in >= min_out").select("branch"), "branch")
    steps = open_.select("branch", F.explode(F.array(F.struct(F.col("in").alias("at"), F.lit(1).alias("d")), F.struct(F.least("out", F.lit(line_len)).alias("at"), F.lit(-1).alias("d")))).alias("e")).select("branch", "e.at", "e.d")
    steps = steps.groupBy("branch", "at").agg(F.sum("d").alias("d"))
    depth = steps.withColumn("covered", F.sum("d").over(W.partitionBy("branch").orderBy("at"))).filter(F.col("at") < line_len)
    best = depth.groupBy("branch").agg(F.max(F.struct(F.col("covered"), (-F.col("at")).alias("neg"))).alias("b"))
    return exact.unionByName(best.select("branch", (-F.col("b.neg")).alias("position"), F.lit(False).alias("exact"), F.col("b.covered").alias("covered")))


def root_refs(touches: DataFrame, live_roots: DataFrame) -> DataFrame:
    """root, atom: the last atom that touched each root which still has a live file.  touches: root, rev, atom."""
    last = touches.filter("root is not null").groupBy("root").agg(F.max_by("atom", "rev").alias("atom"))
    return last.join(live_roots.select("root").distinct(), "root", "left_semi")


def copy_source(candidates: DataFrame) -> DataFrame:
    """copy, atom of the first candidate that maps: candidates have copy, priority, atom (null: does not map)."""
    return candidates.filter("atom is not null").groupBy("copy").agg(F.min_by("atom", "priority").alias("atom"))


def empty_folders(added: DataFrame, live: DataFrame) -> DataFrame:
    """Added folders (path) below which no file lives."""
    from .asof import ancestors

    held = live.select(F.explode(ancestors("path")).alias("path")).distinct()
    return added.join(held, "path", "left_anti")


def vendor_only_points(revisions: DataFrame) -> DataFrame:
    """Files whose 1.1 and 1.1.1.1 have the same date and content: (path, point).  revisions: path, rev (text), date, blob."""
    a, b = revisions.filter("rev = '1.1'").alias("a"), revisions.filter("rev = '1.1.1.1'").alias("b")
    return a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.date") == F.col("b.date")) & (F.col("a.blob") == F.col("b.blob"))).select(F.col("a.path").alias("path"), F.lit("1.1").alias("point"))
