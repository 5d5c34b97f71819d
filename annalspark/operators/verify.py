"""Constraint queries over a history: each check is a table of violations that must be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import canon
from ..storage import Rounds, written
from .asof import asof_last
from .graph import heavy_lines

CHECKS = ("integrity", "structure", "replay", "derivations", "source-invariants", "provenance", "loss-boundary")
# Parameters that a derivation of each kind must carry.
REQUIRED = {
    "inferred-rename": ("rename_algorithm", "rename_threshold"),
    "reconstructed-changeset": ("window_secs", "cluster_keys", "date_rule", "confidence_rule"),
}


def missing_params(kind: Column, params: Column) -> Column:
    """Required parameters that a derivation lacks; a reconstructed branch needs `layout` or `source`."""
    have = F.map_keys(params)
    out = None
    for k, names in REQUIRED.items():
        need = F.array_except(F.array(*map(F.lit, names)), have)
        out = F.when(kind == k, need) if out is None else out.when(kind == k, need)
    either = F.array_contains(have, "layout") | F.array_contains(have, "source")
    return out.when((kind == "reconstructed-branch") & ~either, F.array(F.lit("layout|source"))).otherwise(F.array().cast("array<string>"))


def _row(df: DataFrame, check: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), detail.alias("detail"))


def _hex(c: str) -> Column:
    return F.lower(F.hex(c))


def structure(h) -> DataFrame:
    """Parents and copy sources are strictly earlier, ids unique, one op per path and atom, ref targets exist, refs unique."""
    at = h.atoms.select("atom_id", "atom_idx")
    up = at.select(F.col("atom_id").alias("parent_id"), F.col("atom_idx").alias("parent_idx"))
    late = h.parents.join(at, "atom_id").join(up, "parent_id", "left").filter("parent_idx is null or parent_idx >= atom_idx")
    src = at.select(F.col("atom_id").alias("from_atom"), F.col("atom_idx").alias("from_idx"))
    copies = h.copies.join(at, "atom_id").join(src, "from_atom", "left").filter("from_idx is null or from_idx >= atom_idx")
    twice = h.atoms.groupBy("atom_id").count().filter("count > 1")
    ops = h.ops.groupBy("atom_id", "path").count().filter("count > 1")
    lost = h.refs.filter("target is not null").join(at.select(F.col("atom_id").alias("target")), "target", "left_anti")
    names = h.refs.groupBy("name", "kind").count().filter("count > 1")  # all other kinds are one kind
    out = _row(late, "structure", F.concat(F.lit("parent not earlier: "), _hex("atom_id")))
    for df, text in ((copies, F.concat(F.lit("copy source not earlier: "), F.col("to"))), (twice, F.concat(F.lit("atom twice: "), _hex("atom_id"))), (ops, F.concat(F.lit("path twice: "), F.col("path"))), (lost, F.concat(F.lit("ref without target: "), F.col("name"))), (names, F.concat(F.lit("ref twice: "), F.col("name")))):
        out = out.unionAll(_row(df, "structure", text))
    return out


def integrity(h) -> DataFrame:
    """Stored contents hash to their ids; every used blob is stored and every stored one used."""
    wrong = h.blobs.filter(F.col("content").isNotNull() & (F.unhex(F.sha2("content", 256)) != F.col("blob_id")))
    used = h.ops.filter("blob_id is not null").select("blob_id").distinct()
    out = _row(wrong, "integrity", F.concat(F.lit("content is not its id: "), _hex("blob_id")))
    out = out.unionAll(_row(used.join(h.blobs, "blob_id", "left_anti"), "integrity", F.concat(F.lit("missing blob: "), _hex("blob_id"))))
    return out.unionAll(_row(h.blobs.select("blob_id").join(used, "blob_id", "left_anti"), "integrity", F.concat(F.lit("unused blob: "), _hex("blob_id"))))


def misfits(ops: DataFrame, nodes: DataFrame, first_parents: DataFrame) -> DataFrame:
    """node, path, op: ops that do not fit the tree their first parents left: Add needs absence, the others presence.

    ops: node, path, op; nodes: node (and near, see `graph.heavy_lines`); first_parents: node, up.  Nodes are cut into lines, one row a node.  Inside a
    line the state of a path is that of the last Add or Delete before; where a line has none, its paths take the state
    at the place the line forked from, a lookup per line and path that is passed on to the next line below only where
    that one has no state either.
    """
    rounds = Rounds(ops.sparkSession, "entering")
    links = first_parents.select("node", "up")
    places = heavy_lines(nodes, links)
    below = places.select(F.col("node").alias("up"), F.col("line").alias("to_line"), F.col("rank").alias("to_rank"))
    forks = written(places.filter("rank = 0").join(links, "node").join(below, "up").select("line", "to_line", "to_rank"), "forks")
    before = W.partitionBy("line", "path").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    placed = ops.select("node", "path", "op").join(places, "node")
    placed = written(placed.withColumn("state", F.last(F.when(F.col("op").isin("Add", "Delete"), F.col("op")), ignorenulls=True).over(before)), "placed")
    states = placed.filter("op in ('Add', 'Delete')").select("line", "path", "rank", F.col("op").alias("left"))
    asked = rounds.write(placed.filter("state is null").select(F.col("line").alias("own"), "path").distinct().join(forks.withColumnRenamed("line", "own"), "own").select("own", "path", F.col("to_line").alias("line"), F.col("to_rank").alias("rank")))
    entering = None
    while not asked.isEmpty():
        known = states.join(asked.select("line", "path").distinct(), ["line", "path"], "left_semi")
        answered = rounds.write(asof_last(asked, known, ["line", "path"], "rank", ["left"]))
        found = answered.filter("left is not null").select("own", "path", "left")
        entering = found if entering is None else entering.unionAll(found)
        asked = rounds.write(answered.filter("left is null").drop("left", "rank").join(forks, "line").select("own", "path", F.col("to_line").alias("line"), F.col("to_rank").alias("rank")))
    if entering is not None:
        placed = placed.join(entering.select(F.col("own").alias("line"), "path", F.col("left").alias("entered")), ["line", "path"], "left").withColumn("state", F.coalesce("state", "entered"))
    present = F.coalesce(F.col("state") == "Add", F.lit(False))
    return placed.filter((F.col("op") == "Add") == present).select("node", "path", "op")


def replay(h) -> DataFrame:
    """Ops that do not fit the tree their first parents left."""
    at = h.atoms.select(F.col("atom_id").alias("node"), "atom_idx")
    # a parent that is not earlier is a fault of its own (`structure`) and no step of a line
    first = h.parents.filter("pos = 0").select(F.col("atom_id").alias("node"), F.col("parent_id").alias("up"))
    earlier = at.select(F.col("node").alias("up"), F.col("atom_idx").alias("up_idx"))
    first = written(first.join(at, "node").join(earlier, "up").filter("up_idx < atom_idx").groupBy("node").agg(F.min("up").alias("up")), "first")
    found = misfits(h.ops.withColumnRenamed("atom_id", "node"), written(at.select("node").distinct(), "atoms"), first)
    return _row(found.distinct(), "replay", F.concat("op", F.lit(" "), "path", F.lit(" in "), _hex("node")))


def _statuses(h) -> DataFrame:
    out = None
    for df, what in ((h.atoms, "atom"), (h.ops, "op"), (h.copies, "copy"), (h.refs, "ref")):
        one = df.select(F.lit(what).alias("what"), "status")
        out = one if out is None else out.unionAll(one)
    return out


def derivations(h) -> DataFrame:
    """Derived statuses, also below transform layers, name their maker and version and carry their parameters."""
    d = _statuses(h).filter("status.base = 'derived'").select("what", "status.derivation.*").withColumn("missing", missing_params(F.col("kind"), F.coalesce("params", F.create_map().cast("map<string,string>"))))
    bad = d.filter((F.coalesce("by", F.lit("")) == "") | (F.coalesce("decoder_version", F.lit("")) == "") | (F.col("confidence") > 100) | (F.size("missing") > 0))
    return _row(bad, "derivations", F.concat("what", F.lit(": "), F.coalesce("kind", F.lit("")), F.lit(" "), F.array_join("missing", ",")))


def source_invariants(h) -> DataFrame:
    """What each kind of source can state: rules by the history's source kind."""
    kind = h.provenance.select("source_kind").first()
    kind = kind[0] if kind else None
    n = h.parents.groupBy("atom_id").agg(F.count(F.lit(1)).alias("n"))
    many = lambda k: _row(n.filter(F.col("n") > k), "source-invariants", F.concat(F.lit("too many parents: "), _hex("atom_id")))
    stated = lambda df, text: _row(df.filter("status.base <> 'derived'"), "source-invariants", F.lit(text))
    none = _row(h.atoms.limit(0), "source-invariants", F.lit(""))
    if kind == "cvs":
        right = F.col("status.derivation.kind").isin("reconstructed-changeset", "reconstructed-branch")
        return stated(h.atoms, "atom not derived").unionAll(_row(h.atoms.filter("status.base = 'derived'").filter(~right), "source-invariants", F.lit("atom of another derivation"))).unionAll(stated(h.refs, "ref not derived")).unionAll(_row(h.copies, "source-invariants", F.lit("copies cannot be stated")))
    if kind == "svn":
        return _row(h.atoms.filter("status.base <> 'stated'"), "source-invariants", F.lit("atom not stated")).unionAll(many(1)).unionAll(stated(h.refs, "ref not derived"))
    if kind == "git":
        return stated(h.copies, "copy not derived")
    if kind == "hg":
        return many(2)
    return none


def provenance(h) -> DataFrame:
    empty = [F.coalesce(F.col(c), F.lit("")) == "" for c in ("tool_version", "decoder_version", "source_kind")]
    return _row(h.provenance.filter(empty[0] | empty[1] | empty[2]), "provenance", F.lit("an empty version or kind"))


def loss_boundary(h) -> DataFrame:
    return _row(h.drops.filter((F.coalesce("what", F.lit("")) == "") | (F.coalesce("reason", F.lit("")) == "")), "loss-boundary", F.col("class"))


def transform_chain(h) -> DataFrame:
    """Layers name steps of the chain, strictly decreasing from the outermost; copies have none."""
    steps = h.transforms.agg(F.coalesce(F.max("step"), F.lit(0)).alias("last"))
    rows = _statuses(h).crossJoin(F.broadcast(steps))  # one row
    s = F.transform("status.layers", lambda x: x["step"])
    falling = F.forall(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: (F.size(s) <= i) | (F.get(s, i) < F.get(s, i - 1)))
    bad = rows.filter((F.size(s) > 0) & (~falling | (F.array_max(s) > F.col("last")) | (F.array_min(s) < 1) | (F.col("what") == "copy")))
    return _row(bad, "structure", F.concat("what", F.lit(": layers out of order")))


def readable(h, contract: tuple[int, int]) -> DataFrame:
    """A 0.2 history must not carry transforms."""
    if contract != (0, 2):
        return _row(h.transforms.limit(0), "structure", F.lit(""))
    layered = _statuses(h).filter("size(status.layers) > 0").select("what")
    return _row(h.transforms.select(F.lit("transforms").alias("what")).unionAll(layered).unionAll(h.drops.filter("step is not null").select(F.lit("drop").alias("what"))), "structure", F.col("what"))


def violations(h) -> DataFrame:
    """All checks' violations: check, detail."""
    out = integrity(h)
    for part in (structure(h), transform_chain(h), replay(h), derivations(h), source_invariants(h), provenance(h), loss_boundary(h)):
        out = out.unionAll(part)
    return out


def outcomes(h) -> DataFrame:
    """position, check, outcome (pass, fail, not-checked) and the number of violations, in the fixed order."""
    spark = h.atoms.sparkSession
    names = spark.createDataFrame(list(enumerate(CHECKS)), "position int, check string")
    n = violations(h).groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    known = h.provenance.agg(F.coalesce(F.bool_and(F.col("source_kind").isin("git", "hg", "svn", "cvs")), F.lit(False)).alias("known"))
    rows = names.join(n, "check", "left").crossJoin(F.broadcast(known))  # one row
    state = F.when((F.col("check") == "source-invariants") & ~F.col("known"), "not-checked").when(F.coalesce("n", F.lit(0)) > 0, "fail").otherwise("pass")
    return rows.select("position", "check", state.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("position")


def verdict(h) -> tuple[str, list]:
    """pass, fail or incomplete, with the outcomes."""
    rows = outcomes(h).collect()  # seven rows
    states = {r["outcome"] for r in rows}
    return ("fail" if "fail" in states else "incomplete" if "not-checked" in states else "pass"), rows


def against_source(mine: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that only one of two derivations has: side, and the rows' columns."""
    return mine.exceptAll(again).withColumn("side", F.lit("stored")).unionByName(again.exceptAll(mine).withColumn("side", F.lit("source")))


def restamped(h, tool_version: str, decoder_version: str):
    """The same history as another version would have written it: versions in provenance and derivations, ids rebuilt."""
    def stamped(df: DataFrame) -> DataFrame:
        derivation = F.col("status.derivation").withField("decoder_version", F.lit(decoder_version))
        return df.withColumn("status", F.when(F.col("status.derivation").isNotNull(), F.col("status").withField("derivation", derivation)).otherwise(F.col("status")))

    atoms = stamped(h.atoms).withColumnsRenamed({"atom_id": "node", "atom_idx": "position"})
    ops, copies = stamped(h.ops).withColumnRenamed("atom_id", "node"), stamped(h.copies).withColumnsRenamed({"atom_id": "node", "from_atom": "from_node"})
    parents = h.parents.withColumnsRenamed({"atom_id": "node", "parent_id": "parent"})
    ids = written(canon.atom_ids(atoms, parents, ops, copies), "restamped")

    def swapped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        for old, new in columns.items():
            df = df.join(ids.select(F.col("node").alias(old), F.col("atom_id").alias(new)), old, "left").drop(old)
        return df

    tables = {"atoms": swapped(atoms, {"node": "atom_id"}).withColumnRenamed("position", "atom_idx"), "parents": swapped(parents, {"node": "atom_id", "parent": "parent_id"}), "ops": swapped(ops, {"node": "atom_id"}), "copies": swapped(copies, {"node": "atom_id", "from_node": "from_atom"})}
    refs = stamped(h.refs).withColumnRenamed("target", "old")
    tables["refs"] = swapped(refs, {"old": "target"})
    made = h.provenance.withColumn("tool_version", F.lit(tool_version)).withColumn("decoder_version", F.lit(decoder_version))
    return h.replace(provenance=made, **{k: df.select(getattr(h, k).columns) for k, df in tables.items()})


def rederived(stored, again) -> DataFrame:
    """Atoms that only one of two histories has once both are stamped with the stored one's versions: side, atom_id."""
    v = stored.provenance.select("tool_version", "decoder_version").first()
    aligned = restamped(again, v["tool_version"], v["decoder_version"])
    return against_source(stored.atoms.select("atom_id"), aligned.atoms.select("atom_id"))


def trunk_after_vendor(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """Files with a default vendor branch that also have a trunk revision above 1.1: ambiguous, to be refused."""
    later = revisions.filter((F.size("rev") == 2) & ~((F.get("rev", F.lit(0)) == 1) & (F.get("rev", F.lit(1)) == 1))).select("path").distinct()
    return files.filter("vendor_branch is not null").join(later, "path", "left_semi")
