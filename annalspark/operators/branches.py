"""Branches of per-file revision numbers: discovery, parent lines, runs on the parent line, and what is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from .refs import cut_points

#: Rows of a partition of `discover`.
_ROWS = 1 << 17


def named_branches(symbols: DataFrame) -> DataFrame:
    """path, name, branch, point of symbols (path, name, rev) that name a branch, by a magic or a plain branch number."""
    r = F.col("rev")
    magic = S.magic_branch(r)
    branch = F.when(magic.isNotNull(), magic["branch"]).otherwise(r)
    point = F.when(magic.isNotNull(), magic["point"]).otherwise(S.branch_of(r))
    return symbols.filter(S.names_branch(r)).select("path", "name", branch.alias("branch"), point.alias("point"))


def line_of(revisions: DataFrame, branches: DataFrame, vendors: DataFrame | None = None, parts: int = 0) -> DataFrame:
    """Adds `line` to revisions (path, rev): '' for the main line, a branch's name, or null for an unnamed line.

    Where two names share a branch number the lower one is taken.  vendors: path, vendor (default branch number).
    parts: in how many partitions both are joined, if given.
    """
    dealt = lambda df: df.repartition(parts, "path", "branch") if parts else df
    names = dealt(branches).groupBy("path", "branch").agg(F.min("name").alias("line"))
    rows = dealt(revisions.withColumn("branch", S.branch_of(F.col("rev")))).join(names, ["path", "branch"], "left").drop("branch")
    if vendors is None:
        return rows.withColumn("line", F.when(F.size("rev") == 2, "").otherwise(F.col("line")))
    return rows.join(vendors, "path", "left").withColumn("line", F.when(S.is_main_line(F.col("rev"), F.col("vendor")), "").otherwise(F.col("line"))).drop("vendor")


def discover(symbols: DataFrame, revisions: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    """name, path, branch, point, state, line of every file on every branch.

    state is that of the branch point: live, dead, or missing where the file has no such revision.
    """
    found = named_branches(symbols)
    # numbers are short when compressed, so that partitions merged by size would hold too many of them
    parts = -(-(revisions.count() + found.count()) // _ROWS) or 1
    points = line_of(revisions.select("path", "rev", "state"), found, vendors, parts).select("path", F.col("rev").alias("point"), "state", "line")
    joined = found.repartition(parts, "path", "point").join(points.repartition(parts, "path", "point"), ["path", "point"], "left")
    state = F.when(F.col("state").isNull(), "missing").when(F.col("state") == "dead", "dead").otherwise("live")
    return joined.select("name", "path", "branch", "point", state.alias("state"), "line")


def wanted_parents(entries: DataFrame) -> DataFrame:
    """name, parent for `graph.branch_waves`: the majority line of live points; the main line where none constrains."""
    from .refs import majority_line

    most = majority_line(entries.filter("state = 'live'").select(F.col("name").alias("branch"), "line")).select(F.col("branch").alias("name"), F.col("line").alias("parent"))
    free = entries.groupBy("name").agg(F.bool_or(F.col("state") == "live").alias("bound"))
    return free.join(most, "name", "left").select("name", F.when(F.col("bound"), F.col("parent")).otherwise("").alias("parent"))


def plan(entries: DataFrame, members: DataFrame, parent: DataFrame, line_len: int) -> DataFrame:
    """branch, position, exact, covered: where each branch leaves the main line.

    members: idx, path, rev of the line's changesets.  A file is at its branch point from the changeset that brings the
    point until the one that brings its next revision on the line.
    """
    order = W.partitionBy("path").orderBy("idx", "rev")
    stays = members.withColumn("out", F.coalesce(F.lead("idx").over(order), F.lit(line_len)))
    live = entries.filter("state = 'live' and line = ''").join(parent.filter("parent = ''").select("name"), "name")
    runs = live.join(stays.select("path", F.col("rev").alias("point"), F.col("idx").alias("in"), "out"), ["path", "point"])
    return cut_points(runs.select(F.col("name").alias("branch"), "in", "out"), line_len)


def excluded(revisions: DataFrame, symbols: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    """line, revisions, files: what lies outside the main line, by named line (null: unnamed)."""
    rows = line_of(revisions.select("path", "rev"), named_branches(symbols), vendors).filter("line is null or line <> ''")
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("revisions"), F.count_distinct("path").alias("files"))


def property_losses(nodes: DataFrame) -> DataFrame:
    """revision, mergeinfo, workflow, custom: which kinds of node properties a revision sets that a history cannot hold."""
    k = F.explode(F.col("props.k")).alias("k")
    rows = nodes.select("revision", k)
    workflow = ("svn:ignore", "svn:global-ignores", "svn:needs-lock", "svn:keywords", "svn:eol-style", "svn:mime-type", "svn:auto-props")
    kept = ("svn:executable", "svn:special", "svn:externals")
    custom = ~F.col("k").isin("svn:mergeinfo", *workflow, *kept)
    return rows.groupBy("revision").agg(F.bool_or(F.col("k") == "svn:mergeinfo").alias("mergeinfo"), F.bool_or(F.col("k").isin(*workflow)).alias("workflow"), F.bool_or(custom).alias("custom")).filter("mergeinfo or workflow or custom")


def externals(nodes: DataFrame) -> DataFrame:
    """Nodes with externals, which a history refuses."""
    return nodes.filter(F.exists(F.col("props.k"), lambda k: k == "svn:externals")).select("revision", "path")
