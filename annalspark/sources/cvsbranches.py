"""Branches of a CVS repository: each leaves its parent line at a cut, with an atom for what its files differ there.

Branches are built wave by wave, parents first; all branches of a wave are built together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import branches as branching
from ..operators import cluster, diff, graph
from ..operators.refs import cut_points
from ..storage import written

_END = 1 << 40
_SEP = "\x00"

#: Files on lines: the state that node `node`, the n-th of its line, gives a path.
STATES = ["line", "n", "node", "path", "rev", "live", "blob_id", "date"]


def _inside(revs: DataFrame) -> DataFrame:
    """Revisions with the line in front of author and path, so that nothing is clustered or counted across lines."""
    mark = lambda c: F.concat(F.col("line"), F.lit(_SEP), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return revs.withColumn("author", mark("author")).withColumn("path", mark("path"))


def _changesets(revs: DataFrame, window: int) -> DataFrame:
    """line, n, node, author, log, latest, confidence and members of the changesets of every line."""
    made = cluster.changesets(_inside(revs), window)
    strip = lambda c: F.substring_index(c, _SEP, -1)
    members = F.transform("members", lambda m: F.struct(strip(m["path"]).alias("path"), m["rev"].alias("rev")))
    made = made.withColumn("members", members).withColumn("line", F.substring_index("author", _SEP, 1)).withColumn("author", strip(F.col("author")))
    made = made.withColumn("n", F.row_number().over(W.partitionBy("line").orderBy("changeset")).cast("long"))
    text = F.array_join(F.array_sort(F.transform("members", lambda m: F.concat(m["path"], F.lit("@"), S.dotted(m["rev"])))), "\n")
    return made.withColumn("node", F.encode(F.concat(F.lit("branch "), "line", F.lit("\n"), text), "UTF-8")).select("line", "n", "node", "author", "log", "latest", "confidence", "members")


def _cuts(entries: DataFrame, states: DataFrame) -> DataFrame:
    """branch, parent, position, exact, covered: where each branch leaves its parent line."""
    stays = states.withColumn("out", F.coalesce(F.lead("n").over(W.partitionBy("line", "path").orderBy("n", "rev")), F.lit(_END)))
    met = entries.join(stays.select(F.col("line").alias("parent"), "path", F.col("rev").alias("point"), F.col("n").alias("in"), "out"), ["parent", "path", "point"])
    cuts = cut_points(met.select(F.col("name").alias("branch"), "in", "out"), _END)
    return cuts.join(entries.select(F.col("name").alias("branch"), "parent").distinct(), "branch").join(entries.groupBy(F.col("name").alias("branch")).agg(F.count(F.lit(1)).alias("files")), "branch")


def build(revisions: DataFrame, symbols: DataFrame, vendors: DataFrame, main: DataFrame, window: int) -> dict[str, DataFrame]:
    """atoms (node, wave, line, n, kind, author, log, date, confidence), parents, ops, refs (name, target) and blocked names.

    revisions: path, rev, date, author, log, state, blob_id; main: STATES of the main line ('').
    """
    entries = written(branching.discover(symbols, revisions, vendors), "cvs-entries")
    imported, blocked = graph.branch_waves(branching.wanted_parents(entries))
    starts = entries.filter("state = 'live'").join(imported.select("name", "parent", "wave"), "name").filter("line = parent")
    starts = written(starts.join(revisions.select("path", F.col("rev").alias("point"), "blob_id"), ["path", "point"]), "cvs-starts")
    own = branching.line_of(revisions, branching.named_branches(symbols), vendors).join(starts.select(F.col("name").alias("line"), "wave").distinct(), "line")
    own = written(own, "cvs-own")
    states, out = main.select(STATES), []
    for (wave,) in starts.select("wave").distinct().orderBy("wave").collect():  # a row per depth of branches
        here = starts.filter(F.col("wave") == wave)
        cuts = written(_cuts(here, states), "cvs-cuts")
        left = states.select(F.col("line").alias("parent"), "n", "node", "path", "live", "blob_id", "date").join(cuts.select("branch", "parent", "position"), "parent").filter("n <= position")
        tree = left.groupBy("branch", "path").agg(F.max_by(F.struct("live", "blob_id"), "n").alias("s")).filter("s.live").select(F.col("branch").alias("atom"), "path", F.col("s.blob_id").alias("blob"))
        at = left.groupBy("branch").agg(F.max_by("node", "n").alias("cut"), F.max_by("date", "n").alias("date"))
        begin = here.select(F.col("name").alias("atom"), "path", F.col("blob_id").alias("blob"))
        point = lambda c: F.encode(F.concat(F.lit("branch point "), c), "UTF-8")
        differs = written(diff.snapshot_diff(tree, begin), "cvs-points")
        points = differs.select(F.col("atom").alias("branch")).distinct().join(at, "branch").join(cuts, "branch")
        made = written(_changesets(own.filter(F.col("wave") == wave).drop("wave"), window), "cvs-branch-changesets")
        origin = at.join(differs.select(F.col("atom").alias("branch"), F.lit(True).alias("own")).distinct(), "branch", "left").select(F.col("branch").alias("line"), "cut", F.when(F.col("own"), point(F.col("branch"))).otherwise(F.col("cut")).alias("first"))
        member = made.select("line", "n", "node", F.explode("members").alias("m")).select("line", "n", "node", "m.path", "m.rev").join(own.drop("line", "wave"), ["path", "rev"])
        member = member.select("line", "n", "node", "path", "rev", (F.col("state") != "dead").alias("live"), "blob_id", "date")
        base = here.drop("line").join(origin, F.col("name") == F.col("line")).select(F.col("name").alias("line"), F.lit(0).cast("long").alias("n"), F.col("first").alias("node"), "path", F.col("point").alias("rev"), F.lit(True).alias("live"), "blob_id", F.lit(None).cast("bigint").alias("date"))
        now = written(member.unionByName(base.select(STATES)), "cvs-branch-states")
        ops = diff.running_ops(now.withColumn("pos", F.struct("n", "rev"))).filter("op is not null and n > 0").select("node", "path", "op", "blob_id")
        ops = ops.unionByName(differs.select(point(F.col("atom")).alias("node"), "path", "op", F.col("new_blob").alias("blob_id")))
        share = F.when(F.col("exact"), 100).otherwise((F.col("covered") * 100 / F.col("files")).cast("int"))
        none = F.lit(None)
        atoms = made.select("node", F.lit(wave).alias("wave"), "line", "n", F.lit("reconstructed-changeset").alias("kind"), "author", "log", F.col("latest").alias("date"), F.col("confidence").cast("int").alias("confidence"))
        atoms = atoms.unionByName(points.select(point(F.col("branch")).alias("node"), F.lit(wave).alias("wave"), F.col("branch").alias("line"), F.lit(0).cast("long").alias("n"), F.lit("reconstructed-branch").alias("kind"), none.cast("string").alias("author"), none.cast(made.schema["log"].dataType).alias("log"), "date", share.alias("confidence")))
        before = F.lag("node").over(W.partitionBy("line").orderBy("n"))
        parents = made.select("node", "line", before.alias("parent")).join(origin.select("line", "first"), "line").select("node", F.coalesce("parent", "first").alias("parent"))
        parents = parents.unionByName(points.select(point(F.col("branch")).alias("node"), F.col("cut").alias("parent")))
        last = origin.join(made.groupBy("line").agg(F.max_by("node", "n").alias("last")), "line", "left").select(F.col("line").alias("name"), F.coalesce("last", "first").alias("target"))
        out.append({"atoms": written(atoms, "cvs-branch-atoms"), "parents": written(parents, "cvs-branch-parents"), "ops": written(ops, "cvs-branch-ops"), "refs": written(last, "cvs-branch-refs")})
        states = states.unionByName(now.select(STATES))
    result = {}
    for part in out:
        result = {k: result[k].unionByName(df) if k in result else df for k, df in part.items()}
    return result | {"lines": own.select("path", "rev"), "blocked": blocked}
