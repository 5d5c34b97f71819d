"""URL filter: a path-template tree per host, with native DataFrame operations only.

1. Every url is cut into host and path.  Path segments are generalised by shape (runs of digits and long hexadecimal
   names become wildcards, file suffixes stay), which gives each url its raw template.
2. Distinct (host, template) pairs form the tree: `depth` levels of segments, then the rest of the path as the last one.
   Level by level from the root, the children of a node that occur seldom become one wildcard if they are many.  The
   others are ordered by their smoothed share of bad pages, and the cut between neighbours that tells the labelled
   pages on both sides apart best is tested.  If it is significant, the siblings on either side merge into a branch of
   their own (`*` below the cut, `*!` above it); if none is, all of them are alike and merge into one.
3. A template is rejected when its smoothed share of bad labels, shrunk towards its host's and that towards the
   overall share, reaches `threshold`.

Rules come first: the longest one whose host (or a parent domain of the url's host) and path prefix fit decides alone.

The tree is built from one row per (host, raw template), pre-aggregated before any shuffle.  Everything in it is an
aggregate or an equi-join; the only window is over the `buckets` shares of a node, so a host with many distinct paths is
no hot task.  Levels are written tables.  Verdicts go back by an equi-join on (host, raw template) that adaptive
execution may split or broadcast by measured size.

Cases: a null url, or one without "://", has empty host and path, no rule, and takes the verdict of that template;
repeated pages are each judged; no labels at all means everything is allowed but for rules; null page ids pass on;
extra columns are ignored; very long paths are kept whole.  Ties between cuts go to the lower share; a node without
labelled pages has no cut.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Stages

#: Rules of the query: verdict, host, path prefix.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@dataclass(frozen=True)
class TreeParams:
    depth: int = 3
    #: Children of fewer pages become a wildcard if a node has at least so many of them.
    rare_pages: float = 8.0
    min_children: int = 20
    #: A cut between siblings counts from so many standard deviations on.
    z: float = 3.0
    buckets: int = 32
    prior_weight: float = 4.0
    threshold: float = 0.5


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(url.isNotNull() & (F.instr(url, "://") > 0), F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    tail = F.substr(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + F.lit(1))
    return F.when(url.isNotNull() & (F.instr(url, "://") > 0), F.regexp_extract(tail, r"^[^?#]*", 0)).otherwise(F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def raw_template(path: Column) -> Column:
    """The path with hexadecimal names of 8 or more signs, at least one a digit, and runs of digits as wildcards."""

    def one(seg: Column) -> Column:
        stem = F.regexp_extract(seg, r"^([0-9a-f]{8,})([.][0-9A-Za-z]+)?$", 1)
        return F.when(F.regexp_like(stem, F.lit("[0-9]")), F.concat(F.lit("*"), F.substr(seg, F.length(stem) + F.lit(1)))).otherwise(F.regexp_replace(seg, r"[0-9]+", "*"))

    return F.array_join(F.transform(F.split(path, "/"), one), "/")


def _level(tree: DataFrame, seg: Column, p: TreeParams, stages: Stages, name: str) -> DataFrame:
    """The tree (host, raw, n, lab, bad, prefix) with one more level in its prefixes."""
    node = ["host", "prefix"]
    tree = tree.withColumn("seg", seg)
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    child = stages.write(tree.groupBy(*node, "seg").agg(*sums), f"{name}-child")
    per = child.groupBy(*node).agg(F.sum((F.col("n") < p.rare_pages).cast("int")).alias("rare"), F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
    child = child.join(per, node).withColumn("own", F.when((F.col("n") < p.rare_pages) & (F.col("rare") >= p.min_children), F.lit("*")).otherwise(F.col("seg")))
    kept = child.groupBy(*node, "own").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.max("all_lab").alias("all_lab"), F.max("all_bad").alias("all_bad"))
    share = F.when(F.col("all_lab") > 0, F.col("all_bad") / F.col("all_lab")).otherwise(F.lit(0.0))
    bucket = F.floor(F.lit(float(p.buckets)) * (F.col("bad") + F.lit(p.prior_weight) * share) / (F.col("lab") + F.lit(p.prior_weight)))
    kept = stages.write(kept.withColumn("bucket", bucket), f"{name}-kept")
    cells = kept.groupBy(*node, "bucket").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    whole = W.partitionBy(*node)
    below = whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.select(*node, "bucket", F.sum("lab").over(below).alias("l"), F.sum("bad").over(below).alias("lb"), F.sum("lab").over(whole).alias("t"), F.sum("bad").over(whole).alias("tb"))
    cells = cells.filter("l > 0 and t > l and tb > 0 and tb < t")
    both = F.col("tb") / F.col("t")
    z = F.abs(F.col("lb") / F.col("l") - (F.col("tb") - F.col("lb")) / (F.col("t") - F.col("l"))) / F.sqrt(both * (F.lit(1.0) - both) * (F.lit(1.0) / F.col("l") + F.lit(1.0) / (F.col("t") - F.col("l"))))
    cut = cells.withColumn("z", z).filter(F.col("z") >= p.z).groupBy(*node).agg(F.max(F.struct("z", (-F.col("bucket")).alias("bucket"))).alias("best")).select(*node, (-F.col("best.bucket")).alias("cut"))
    kept = kept.join(cut, node, "left").withColumn("above", F.coalesce(F.col("bucket") > F.col("cut"), F.lit(False)))
    many = kept.groupBy(*node, "above").agg(F.count(F.lit(1)).alias("kids"))
    to = F.when(F.col("kids") == 1, F.col("own")).when(F.col("above"), F.lit("*!")).otherwise(F.lit("*"))
    to = child.select(*node, "seg", "own").join(kept.select(*node, "own", "above"), [*node, "own"]).join(many, [*node, "above"]).select(*node, "seg", to.alias("to"))
    grown = tree.join(to, [*node, "seg"]).select("host", "raw", "n", "lab", "bad", F.concat("prefix", F.lit("/"), "to").alias("prefix"))
    return stages.write(grown, f"{name}-tree")


def templates(pages: DataFrame, params: TreeParams) -> DataFrame:
    """host, raw, template, share (smoothed share of bad pages) from rows of host, raw, bad (1, 0 or null)."""
    stages = Stages(pages.sparkSession, "urls")
    tree = pages.groupBy("host", "raw").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count("bad").cast("double").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    tree = stages.write(tree.withColumn("prefix", F.lit("")), "tree")
    parts = F.split(F.col("raw"), "/")
    for level in range(1, params.depth + 1):
        tree = _level(tree, F.coalesce(F.get(parts, F.lit(level)), F.lit("")), params, stages, f"level-{level}")
    last = params.depth + 1
    tree = _level(tree, F.array_join(F.slice(parts, F.lit(last + 1), F.greatest(F.size(parts) - F.lit(last), F.lit(0))), "/"), params, stages, f"level-{last}")
    stages.retain(f"level-{last}-tree")
    whole = tree.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("lab"), F.lit(0)), F.lit(0.0)).alias("overall"))  # one row
    w = F.lit(params.prior_weight)
    host = tree.groupBy("host").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(whole)).select("host", ((F.col("bad") + w * F.col("overall")) / (F.col("lab") + w)).alias("at_host"))
    leaf = tree.groupBy("host", "prefix").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).join(host, "host")
    leaf = leaf.select("host", "prefix", ((F.col("bad") + w * F.col("at_host")) / (F.col("lab") + w)).alias("share"))
    return tree.select("host", "raw", "prefix").join(leaf, ["host", "prefix"]).select("host", "raw", F.col("prefix").alias("template"), "share")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES, params: TreeParams = TreeParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, template and share of every page.

    labelled: page_id and bad (boolean); several labels of a page count as bad if one is.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("raw", raw_template(F.col("path")))
    if labelled is None:
        marked = base.withColumn("bad", F.lit(None).cast("int"))
    else:
        once = labelled.filter(F.col("page_id").isNotNull()).groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
        marked = base.join(once, "page_id", "left")
    tree = templates(marked.select("host", "raw", "bad"), params)
    name, verdict = rule_column(F.col("host"), F.col("path"), rules)
    by_tree = F.when(F.col("share") >= params.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return base.join(tree, ["host", "raw"], "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_tree).alias("verdict"), "template", "share")


def labels_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages whose path names a labelled document: bad if it is of low quality or toxic."""
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), F.expr("try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)[^/]*/?(?:[?#].*)?$', 1) as bigint)").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality"), F.lit(1)) != 1) | (F.coalesce(F.col("toxic"), F.lit(0)) != 0)).alias("bad"))
    return ids.join(bad, "doc_id").select("page_id", "bad")
