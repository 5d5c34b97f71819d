"""Snapshot differences and exact-content renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def snapshot_diff(base: DataFrame, child: DataFrame, compare: tuple[str, ...] = ("blob",), replaced: DataFrame | None = None) -> DataFrame:
    """Ops that turn base into child: rows (atom, path, op) with both sides' compared columns.

    base and child have atom, path and the compared columns; equality is null-safe.  replaced (atom, path) names paths
    whose node the source stated anew: they are Replace even if nothing else differs.
    """
    b = base.select("atom", "path", F.lit(True).alias("in_base"), *(F.col(c).alias(f"old_{c}") for c in compare))
    c = child.select("atom", "path", F.lit(True).alias("in_child"), *(F.col(c).alias(f"new_{c}") for c in compare))
    same = F.lit(True)
    for k in compare:
        same = same & F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))
    both = b.join(c, ["atom", "path"], "full_outer")
    if replaced is not None:
        both = both.join(replaced.select("atom", "path", F.lit(True).alias("stated")), ["atom", "path"], "left")
    stated = F.coalesce(F.col("stated"), F.lit(False)) if replaced is not None else F.lit(False)
    op = F.when(F.col("in_base").isNull(), "Add").when(F.col("in_child").isNull(), "Delete").when(stated, "Replace").when(~same, "Modify")
    return both.withColumn("op", op).filter("op is not null").drop("in_base", "in_child", "stated")


def exact_renames(ops: DataFrame) -> DataFrame:
    """(atom, blob, from_path, to_path) where a blob is deleted at exactly one path and added at exactly one.

    ops: atom, path, op and blob (of a Delete, the deleted content).  Atoms without a parent should be left out.
    """
    sided = ops.filter(F.col("op").isin("Add", "Delete") & F.col("blob").isNotNull())
    pair = sided.groupBy("atom", "blob").agg(
        F.sum(F.when(F.col("op") == "Delete", 1).otherwise(0)).alias("gone"), F.sum(F.when(F.col("op") == "Add", 1).otherwise(0)).alias("come"),
        F.max(F.when(F.col("op") == "Delete", F.col("path"))).alias("from_path"), F.max(F.when(F.col("op") == "Add", F.col("path"))).alias("to_path"),
    )
    return pair.filter("gone = 1 and come = 1").drop("gone", "come")


def moves(copies: DataFrame, ops: DataFrame, parents: DataFrame) -> DataFrame:
    """The copies (atom_id, from, from_atom, ...) that are moves: from the first parent, and the atom itself deletes the source."""
    first = parents.filter("pos = 0").select("atom_id", F.col("parent_id").alias("from_atom"))
    gone = ops.filter("op = 'Delete'").select("atom_id", F.col("path").alias("from"))
    return copies.join(first, ["atom_id", "from_atom"], "left_semi").join(gone, ["atom_id", "from"], "left_semi")


def snapshot_uses(commits: DataFrame) -> DataFrame:
    """tree, uses: how often each snapshot is compared: as a commit's own, and as the base of each first child.

    commits: node, tree, parent (the first one, null for a root).
    """
    base = commits.filter("parent is not null").select(F.col("parent").alias("node")).join(commits.select("node", "tree"), "node").select("tree")
    return commits.select("tree").unionAll(base).groupBy("tree").agg(F.count(F.lit(1)).alias("uses"))


def running_ops(states: DataFrame) -> DataFrame:
    """Ops of revisions on a running tree: rows (line, path, pos, live) become Add, Modify, Delete; null for no change."""
    was = F.coalesce(F.lag("live").over(W.partitionBy("line", "path").orderBy("pos")), F.lit(False))
    op = F.when(F.col("live") & ~was, "Add").when(F.col("live") & was, "Modify").when(~F.col("live") & was, "Delete")
    return states.withColumn("op", op)


def first_divergence(a: DataFrame, b: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """The smallest position at which two sequences differ; no row when they are equal."""
    x = a.select(position, F.struct(*columns).alias("x"))
    y = b.select(position, F.struct(*columns).alias("y"))
    return x.join(y, position, "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).agg(F.min(position).alias(position)).filter(F.col(position).isNotNull())
