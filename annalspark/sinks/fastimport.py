"""A history as a stream of import commands: contents by mark, commits in order, references, and what was supplied.

Rows (section, a, b, data) are made in parallel; their order is total, so a sorted write gives the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..history import History


def _bytes(*parts: Column | str) -> Column:
    return F.concat(*[F.encode(F.lit(p), "UTF-8") if isinstance(p, str) else p for p in parts])


def _utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def commands(h: History) -> DataFrame:
    """section, a, b, data: the stream's pieces in the order of their first three columns."""
    used = h.blobs.join(h.ops.filter("blob_id is not null").select("blob_id").distinct(), "blob_id", "left_semi")
    marks = used.select("blob_id", F.row_number().over(W.orderBy("blob_id")).alias("mark"))
    n = marks.count()
    mark = lambda c: _utf8(c.cast("string"))
    blobs = used.join(marks, "blob_id").select(F.lit(0).alias("section"), F.col("mark").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), _bytes("blob\nmark :", mark(F.col("mark")), "\ndata ", mark(F.octet_length("content")), "\n", F.col("content"), "\n").alias("data"))
    at = h.atoms.select("atom_id", (F.col("atom_idx") + n + 1).alias("mark"))
    who = lambda p, t: _bytes(_utf8(F.coalesce(S.clean_identity(F.col(f"{p}.name.bytes").cast("string")), F.lit("unknown"))), " <", _utf8(F.coalesce(S.clean_identity(F.col(f"{p}.email.bytes").cast("string")), F.lit(""))), "> ", _utf8(S.rendered_time(F.coalesce(F.col(f"{t}.seconds"), F.lit(0)), F.col(f"{t}.offset_minutes"))))
    parents = h.parents.join(at.select(F.col("atom_id").alias("parent_id"), F.col("mark").alias("up")), "parent_id").groupBy("atom_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "up"))), lambda x: x["up"]).alias("ups"))
    rows = h.atoms.join(at, "atom_id").join(parents, "atom_id", "left")
    message = F.coalesce(F.col("message.bytes"), F.encode(F.lit(""), "UTF-8"))
    lines = F.concat(F.when(F.size("ups") > 0, F.concat(F.lit("from :"), F.get("ups", F.lit(0)).cast("string"), F.lit("\n"))).otherwise(""), F.coalesce(F.array_join(F.transform(F.slice("ups", F.lit(2), F.greatest(F.size("ups"), F.lit(1))), lambda u: F.concat(F.lit("merge :"), u.cast("string"), F.lit("\n"))), ""), F.lit("")))
    commits = rows.select(F.lit(1).alias("section"), "atom_idx", F.lit(0).cast("bigint").alias("b"), _bytes("reset refs/import/head\ncommit refs/import/head\nmark :", mark(F.col("mark")), "\nauthor ", who("author", "author_time"), "\ncommitter ", F.coalesce(F.when(F.col("committer").isNotNull() | F.col("commit_time").isNotNull(), who("committer", "commit_time")), who("author", "author_time")), "\ndata ", mark(F.octet_length(message)), "\n", message, "\n", _utf8(F.coalesce(lines, F.lit("")))).alias("data")).withColumnRenamed("atom_idx", "a")
    order = W.partitionBy("atom_id").orderBy(F.when(F.col("op") == "Delete", 0).otherwise(1), "path")
    ops = h.ops.withColumn("b", F.row_number().over(order).cast("bigint")).join(h.atoms.select("atom_id", "atom_idx"), "atom_id").join(marks, "blob_id", "left")
    path = _utf8(S.quoted_path(F.col("path")))
    change = F.when(F.col("op") == "Delete", _bytes("D ", path, "\n")).otherwise(_bytes("M ", _utf8(F.conv(F.col("mode").cast("string"), 10, 8)), " :", mark(F.col("mark")), " ", path, "\n"))
    changes = ops.select(F.lit(1).alias("section"), F.col("atom_idx").alias("a"), "b", change.alias("data"))
    full = F.when(F.startswith("name", F.lit("refs/")), F.col("name")).when(F.col("kind") == "tag", F.concat(F.lit("refs/tags/"), "name")).otherwise(F.concat(F.lit("refs/heads/"), "name"))
    named = h.refs.join(at.select(F.col("atom_id").alias("target"), "mark"), "target").withColumn("full", full)
    resets = named.select(F.lit(2).alias("section"), F.row_number().over(W.orderBy("full")).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), _bytes("reset ", _utf8(F.col("full")), "\nfrom :", mark(F.col("mark")), "\n\n").alias("data"))
    return blobs.unionByName(commits).unionByName(changes).unionByName(resets)


def stream(h: History):
    """The stream's bytes, piece by piece; the driver holds one piece at a time."""
    for r in commands(h).orderBy("section", "a", "b").toLocalIterator():
        yield bytes(r["data"])
