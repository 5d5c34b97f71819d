"""As-of lookups, prefix copies and replay of path states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_last(probes: DataFrame, states: DataFrame, keys: list[str], at: str, values: list[str], tie: str | None = None) -> DataFrame:
    """Each probe with the last state of its keys whose `at` is not after the probe's (null if there is none).

    Probes and states are one sorted time line per key; the state is carried forward with a running last value, so a
    key with many states costs a sort and not a range join.
    """
    s = states.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).cast("string").alias("_tie") if tie is None else F.col(tie).alias("_tie"), F.struct(*values).alias("_state"), F.lit(None).cast(probes.select(F.struct("*").alias("p")).schema["p"].dataType).alias("_probe"))
    p = probes.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(s.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(s.schema["_state"].dataType).alias("_state"), F.struct("*").alias("_probe"))
    line = W.partitionBy(*keys).orderBy("_at", "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = s.unionByName(p).withColumn("_found", F.last("_state", ignorenulls=True).over(line))
    return both.filter("_side = 1").select("_probe.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def under(path: str, prefix: str):
    """Whether a path is the prefix or lies below it."""
    return (F.col(path) == F.col(prefix)) | F.startswith(F.col(path), F.concat(F.col(prefix), F.lit("/")))


def ancestors(path: str):
    """The path and all folders above it, as an array: turns prefix joins into equi-joins."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def subtree_copy(live: DataFrame, copies: DataFrame) -> DataFrame:
    """Files copied with a folder: live (path, ...) under copies.src re-rooted at copies.dst.

    The prefix condition is an equi-join on the folders above each path, so no pair is tried in vain.
    """
    keyed = live.withColumn("_folder", F.explode(ancestors("path")))
    met = keyed.join(copies, F.col("_folder") == F.col("src"))
    return met.withColumn("new_path", F.concat("dst", F.substring("path", 1, 0), F.expr("substring(path, length(src) + 1)"))).drop("_folder")


def without_subtrees(live: DataFrame, removed: DataFrame) -> DataFrame:
    """live without the paths at or below removed.path."""
    keyed = live.withColumn("_folder", F.explode(ancestors("path"))).join(removed.select(F.col("path").alias("_folder")), "_folder", "left_semi").select("path").distinct()
    return live.join(keyed, "path", "left_anti")


def replay_violations(ops: DataFrame) -> DataFrame:
    """Ops that do not fit the state of their path: Add needs absence, the others presence.

    ops: line, pos (order), path, op.  Presence before an op is that of the last earlier Add or Delete.
    """
    before = W.partitionBy("line", "path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("Add", "Delete"), F.col("op")), ignorenulls=True).over(before)
    present = F.coalesce(last == "Add", F.lit(False))
    return ops.withColumn("present", present).filter((F.col("op") == "Add") == F.col("present"))


def first_use_order(uses: DataFrame) -> DataFrame:
    """Blobs in storage order: each at its first use by (atom_idx, path), ordered by (path, atom_idx)."""
    first = uses.groupBy("blob").agg(F.min(F.struct("atom_idx", "path")).alias("f"))
    return first.select("blob", F.col("f.path").alias("path"), F.col("f.atom_idx").alias("atom_idx"))
