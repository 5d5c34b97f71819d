"""What a history states, derives, loses and flags; its shape; machine-readable output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import machine_value
from .frames import running


def fidelity(atoms: DataFrame, ops: DataFrame, copies: DataFrame, refs: DataFrame, drops: DataFrame, flags: DataFrame, blobs: DataFrame) -> DataFrame:
    """section, label, n.

    Statuses are structs of base, derivation (with kind) and layers.  A derivation counts only where the outermost
    status is a derived one; layers count on atoms and refs; drops count as rows, flags by their counts.
    """
    def outer(df: DataFrame) -> DataFrame:
        return df.filter((F.col("status.base") == "derived") & (F.coalesce(F.size("status.layers"), F.lit(0)) <= 0)).select(F.lit("derived").alias("section"), F.col("status.derivation.kind").alias("label"), F.lit(1).cast("bigint").alias("n"))

    def layers(df: DataFrame, section: str) -> DataFrame:
        return df.select(F.explode("status.layers").alias("l")).select(F.lit(section).alias("section"), F.col("l.step").cast("string").alias("label"), F.lit(1).cast("bigint").alias("n"))

    def total(df: DataFrame, label: str, n: Column | None = None) -> DataFrame:
        return df.agg(F.coalesce(F.sum(n if n is not None else F.lit(1)), F.lit(0)).cast("bigint").alias("n")).select(F.lit("total").alias("section"), F.lit(label).alias("label"), "n")

    rows = outer(atoms).unionAll(outer(ops)).unionAll(outer(copies)).unionAll(outer(refs)).unionAll(layers(atoms, "transformed_atoms")).unionAll(layers(refs, "transformed_refs"))
    rows = rows.unionAll(drops.select(F.lit("dropped").alias("section"), F.col("class").alias("label"), F.lit(1).cast("bigint").alias("n")))
    rows = rows.unionAll(drops.filter("step is not null").select(F.lit("transformed_drops").alias("section"), F.col("step").cast("string").alias("label"), F.lit(1).cast("bigint").alias("n")))
    rows = rows.unionAll(flags.select(F.lit("flagged").alias("section"), F.col("kind").alias("label"), F.col("count").cast("bigint").alias("n")))
    counted = rows.groupBy("section", "label").agg(F.sum("n").alias("n"))
    for df, label, n in ((atoms, "atoms", None), (refs, "refs", None), (blobs, "blobs", None), (blobs, "content_bytes", F.col("length"))):
        counted = counted.unionAll(total(df, label, n))
    return counted


def exit_class(report: DataFrame) -> DataFrame:
    """One row: 30 where anything is flagged, else 10 where anything is lost, else 0."""
    sums = report.agg(F.coalesce(F.sum(F.when(F.col("section") == "flagged", F.col("n"))), F.lit(0)).alias("flagged"), F.coalesce(F.sum(F.when(F.col("section") == "dropped", F.col("n"))), F.lit(0)).alias("dropped"))
    return sums.select(F.when(F.col("flagged") > 0, 30).when(F.col("dropped") > 0, 10).otherwise(0).alias("exit"))


def rank_percentiles(df: DataFrame, value: str) -> DataFrame:
    """min, median, p90, max by rank n/2 and n*9/10 (from 0, clamped), so the median of an even count is the upper one.

    Equal values are counted first, so that the ranks come from a running sum over distinct values.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.orderBy(value))
    ranked = counts.withColumn("upto", upto).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))
    mid, ninety = F.expr("total div 2"), F.least(F.expr("total * 9 div 10"), F.col("total") - 1)
    return ranked.agg(F.min(value).alias("min"), F.min(F.when(F.col("upto") > mid, F.col(value))).alias("median"), F.min(F.when(F.col("upto") > ninety, F.col(value))).alias("p90"), F.max(value).alias("max"))


def tree_sizes(ops: DataFrame, idx: str = "atom_idx") -> DataFrame:
    """Running number of live paths after each atom; a second Add of a live path does not count."""
    was = F.coalesce(F.lag("live").over(W.partitionBy("path").orderBy(idx)), F.lit(False))
    steps = ops.withColumn("live", F.col("op") != "Delete").withColumn("d", F.when(F.col("live") & ~was, 1).when(~F.col("live") & was, -1).otherwise(0))
    per = steps.groupBy(idx).agg(F.sum("d").alias("d"))
    return running(per, [idx], _before=F.col("d")).select(idx, (F.col("_before") + F.col("d")).alias("size"))


def machine_lines(report: DataFrame) -> DataFrame:
    """key=value lines of a report, with a sort key: keys in snake case, labels escaped."""
    key = F.concat("section", F.lit("."), F.replace(F.col("label"), F.lit("-"), F.lit("_")))
    return report.select("section", "label", F.concat(F.when(F.col("section") == "total", F.col("label")).otherwise(key), F.lit("="), machine_value(F.col("n").cast("string"))).alias("line"))


def machine_atoms(atoms: DataFrame, ops: DataFrame) -> DataFrame:
    """Per-atom key=value lines: (atom_idx, part, j, line)."""
    head = atoms.select("atom_idx", F.lit(0).alias("part"), F.lit(0).alias("j"), F.concat(F.lit("atom."), F.col("atom_idx").cast("string"), F.lit(".id="), F.lower(F.hex("atom_id"))).alias("line"))
    j = F.row_number().over(W.partitionBy("atom_id").orderBy("path")) - 1
    body = ops.withColumn("j", j).join(atoms.select("atom_id", "atom_idx"), "atom_id").select("atom_idx", F.lit(1).alias("part"), "j", F.concat(F.lit("atom."), F.col("atom_idx").cast("string"), F.lit(".op."), F.col("j").cast("string"), F.lit("="), F.lower("op"), F.lit(":"), machine_value(F.col("path"))).alias("line"))
    return head.unionAll(body)
