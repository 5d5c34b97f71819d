"""Order and reachability in the revision graph.

Reachability goes by lines.  Every node picks one of its parents, which makes a forest; every node of the forest hands
its line on to the child with the most descendants, so that lines are runs of one edge after another.  What can be
reached is then one number a line (all ranks up to it, or from it on), and a search only follows the edges that change
lines: its rounds grow with the changes of line, not with the depth of the graph.  Lines are found by following links
inside stretches of nodes, and between stretches by pointer jumping, where every round doubles the distance.  Rounds are written below spark.checkpoint.dir, so that lineage stays short and
a lost executor costs one round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds, written

#: Less than any rank, also where ranks are counted downwards.
_NOWHERE = -(1 << 62)
#: Steps of a loop between two writes; their exchanges are shared, so a step more costs less than a round more.
_JUMPS, _CHANGES = 2, 3
#: Nodes whose links one task follows at a time; up to 2**_FEW - 1 nodes are not cut into stretches.
_STRETCH, _FEW = 1 << 18, 10


def _inside(stretch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of a stretch (node, up): the row of `up` (-1: not here), the last row its links lead to, and the links up to there."""
    to = pc.index_in(stretch["up"].combine_chunks(), value_set=stretch["node"].combine_chunks(), skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    last, steps = np.where(to < 0, np.arange(len(to)), to), (to >= 0).astype(np.int64)
    for _ in range(len(to).bit_length() + 1):  # more only on a cycle, which `_doubled` finds
        after = last[last]
        if np.array_equal(after, last):
            break
        last, steps = after, steps + steps[last]
    return to, last, steps


def _sums(to: np.ndarray, steps: np.ndarray, own: np.ndarray) -> list[int]:
    """What each row and the rows that lead to it hold."""
    sums, above = own.tolist(), to.tolist()
    for i in np.argsort(-steps, kind="stable").tolist():
        if above[i] >= 0:
            sums[above[i]] += sums[i]
    return sums


def _followed(linked: DataFrame, order: list[str]) -> DataFrame:
    """stretch, node, up, exit, root, depth, size, crosses: links followed inside stretches of the order, which hold a bounded number of nodes.

    linked: node, up and the order's columns.  exit is the first node outside the stretch (else root is known), depth the
    links up to it, size the nodes of the stretch that lead to the node, itself included; crosses: its own link leaves.
    """
    kind, most = linked.schema["node"].dataType.simpleString(), _STRETCH

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, n, made = TaskContext.get().partitionId() << 32, [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            to, last, steps = _inside(rows)
            exits = rows["up"].combine_chunks().take(pa.array(last))
            leaves = exits.is_valid().to_numpy(zero_copy_only=False)
            roots = pc.if_else(pa.array(~leaves), rows["node"].combine_chunks().take(pa.array(last)), pa.scalar(None, rows["node"].type))
            crosses = leaves & ((to < 0) | (to[last] >= 0))  # the latter on a cycle
            columns = [pa.array(np.full(len(to), first + made)), rows["node"], rows["up"], exits, roots, pa.array(steps + leaves), pa.array(_sums(to, steps, np.ones(len(to), np.int64)), pa.int64()), pa.array(crosses)]
            yield from pa.table(columns, names=["stretch", "node", "up", "exit", "root", "depth", "size", "crosses"]).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held.append(batch.slice(at, most))
                n += held[-1].num_rows
                if n >= most:
                    yield from out()
                    held, n, made = [], 0, made + 1
        if n:
            yield from out()

    rows = linked.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "up")
    return written(rows.mapInArrow(follow, f"stretch long, node {kind}, up {kind}, exit {kind}, root {kind}, depth long, size long, crosses boolean"), "stretches")


def _doubled(state: DataFrame, sizes: bool, doublings: int) -> DataFrame:
    """state (node, up, root, depth, size) with all links followed; a node's jump goes twice as far each round.

    A node's size takes in the sizes of the nodes whose jump ends at it (if asked for).
    """
    rounds = Rounds(state.sparkSession, "grown")

    def jumped(state: DataFrame) -> DataFrame:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"))
        size, after = F.col("size"), state
        if sizes:
            gains = state.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("gain"))
            after, size = state.join(gains, "node", "left"), F.col("size") + F.coalesce("gain", F.lit(0))
        # nodes that have reached their root have no key to look up, and would all be one task's
        moved = after.filter("up is not null").join(above, "up", "left").select("node", F.col("next").alias("up"), F.coalesce("top", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), size.alias("size"))
        return moved.unionAll(after.filter("up is null").select("node", "up", "root", "depth", size.alias("size")))

    state = rounds.write(state)
    for _ in range(0, doublings, _JUMPS):
        if state.filter("up is not null").isEmpty():
            return state
        for _ in range(_JUMPS):
            state = jumped(state)
        state = rounds.write(state)
        rounds.keep_last(1)
    raise ValueError("the revision graph has a cycle")


class _Forest:
    """Links (node, up; one way up at most) followed to their ends.

    They are followed inside stretches of nodes first (ordered by `near`, if nodes have it, and node); what is left is
    a forest of the nodes that a link from another stretch leads to.  Where most links are short in that order, those are
    few, and only they are followed by pointer jumping.  Any order gives the same result.  Graphs of few nodes are left
    to the jumps at once.
    """

    def __init__(self, nodes: DataFrame, links: DataFrame, sizes: bool, doublings: int) -> None:
        self.links, self.inside = links.select("node", "up"), None
        order = [c for c in ("near", "node") if c in nodes.columns]
        if doublings <= _FEW + 2:
            own = F.col("up").isNull()
            state = nodes.select("node").join(self.links, "node", "left").select("node", "up", F.when(own, F.col("node")).alias("root"), F.when(own, 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"))
            self.entries = _doubled(state, sizes, doublings)
            return
        self.inside = _followed(nodes.select(*order).join(self.links, "node", "left"), order)
        entered = self.inside.filter("crosses").groupBy(F.col("exit").alias("node")).agg(F.sum("size").alias("size"))
        entries = self.inside.drop("size", "up").join(entered, "node").select("node", F.col("exit").alias("up"), "root", "depth", "size")
        self.entries = _doubled(entries, sizes, doublings)

    def roots(self) -> DataFrame:
        """node, root, depth."""
        if self.inside is None:
            return self.entries.select("node", "root", "depth")
        beyond = self.entries.select(F.col("node").alias("exit"), F.col("root").alias("top"), F.col("depth").alias("more"))
        left = self.inside.filter("exit is not null").join(beyond, "exit", "left").select("node", F.col("top").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        return self.inside.filter("exit is null").select("node", "root", "depth").unionAll(left)

    def sizes(self) -> DataFrame:
        """node, up, size: the number of nodes that lead to the node, itself included."""
        if self.inside is None:
            return self.entries.select("node", "size").join(self.links, "node", "left").select("node", "up", "size")
        if self.entries.isEmpty():
            return self.inside.select("node", "up", "size")
        kind = self.inside.schema["node"].dataType.simpleString()

        def summed(rows: pa.Table) -> pa.Table:
            to, _, steps = _inside(rows)
            return pa.table([rows["node"], rows["up"], pa.array(_sums(to, steps, rows["own"].to_numpy()), pa.int64())], names=["node", "up", "size"])

        own = self.inside.select("stretch", "node", "up").join(self.entries.select("node", "size"), "node", "left")
        return own.select("stretch", "node", "up", (F.coalesce("size", F.lit(0)) + 1).alias("own")).groupBy("stretch").applyInArrow(summed, f"node {kind}, up {kind}, size long")


def _grown(nodes: DataFrame, links: DataFrame, sizes: bool, doublings: int) -> DataFrame:
    """node, root, depth and (if asked for) size, the number of nodes that lead to the node, itself included.

    nodes: node and, where it is known, near, by which a node and the node above it lie close; links: node, up, with one
    way up at most.
    """
    forest = _Forest(nodes, links, sizes, doublings)
    return forest.roots().join(forest.sizes().select("node", "size"), "node") if sizes else forest.roots()


def heavy_lines(nodes: DataFrame, links: DataFrame, doublings: int | None = None) -> DataFrame:
    """node, line, rank: a forest cut into lines of one link after another, earliest nodes at rank 0.

    nodes: node and, where it is known, near; links: node, up.  A node's line goes on to the child with the most
    descendants, so that a way through the forest changes lines at most as often as its size can be halved.
    """
    doublings = doublings or nodes.count().bit_length() + 2
    sizes = _Forest(nodes, links, True, doublings).sizes()
    heirs = sizes.filter("up is not null").groupBy("up").agg(F.max_by("node", F.struct("size", "node")).alias("node"))
    return written(_grown(nodes, heirs.select("node", "up"), False, doublings).select("node", F.col("root").alias("line"), F.col("depth").alias("rank")), "lines")


@dataclass(frozen=True)
class Lines:
    """places: node, line, rank (the line's earliest node has rank 0); crossings: line, rank, to_line, to_rank, the edges to parents on other lines."""

    places: DataFrame
    crossings: DataFrame

    @classmethod
    def of(cls, parents: DataFrame | Lines) -> Lines:
        """Lines of a graph; parents: node, parent and, where they are known, pos and near.

        near is any value of the node (its number, date or group) by which nodes and their parents lie close; it
        changes the work and not the result.  A node's parent in the forest is the one with the longest way down by first parents (greatest parents where
        there is no pos), which keeps a main line whole where the first parent of its merges is a branch.
        """
        if isinstance(parents, Lines):
            return parents
        first = F.min_by("parent", "pos") if "pos" in parents.columns else F.max("parent")
        near = ["near"] if "near" in parents.columns else []
        edges = written(parents.select("node", "parent", *(c for c in ("pos", *near) if c in parents.columns)).filter("node is not null and parent is not null").distinct(), "edges")
        if near:  # of a node without parents: the least of its children's
            ends = edges.select("node", "near", F.lit(0).alias("side")).unionAll(edges.select(F.col("parent").alias("node"), "near", F.lit(1).alias("side")))
            nodes = written(ends.groupBy("node").agg(F.min(F.struct("side", "near"))["near"].alias("near")), "nodes")
        else:
            nodes = written(edges.select("node").unionAll(edges.select(F.col("parent").alias("node"))).distinct(), "nodes")
        doublings = nodes.count().bit_length() + 2
        links = written(edges.groupBy("node").agg(first.alias("up"), F.count_distinct("parent").alias("n")), "links")
        merges = links.filter("n > 1").select("node")
        links = links.drop("n")
        if not merges.isEmpty():
            depths = _grown(nodes, links, False, doublings)
            ways = edges.join(merges, "node", "left_semi").join(depths.select(F.col("node").alias("parent"), "depth"), "parent").join(links, "node")
            best = ways.groupBy("node").agg(F.max_by("parent", F.struct("depth", F.col("parent") == F.col("up"), "parent")).alias("best"))
            links = written(links.join(best, "node", "left").select("node", F.coalesce("best", "up").alias("up")), "links")
        places = heavy_lines(nodes, links, doublings)
        to = places.select(F.col("node").alias("parent"), F.col("line").alias("to_line"), F.col("rank").alias("to_rank"))
        crossings = edges.select("node", "parent").distinct().join(places, "node").join(to, "parent").filter("line <> to_line").select("line", "rank", "to_line", "to_rank")
        return cls(places, written(crossings.distinct(), "crossings"))

    def _turned(self) -> Lines:
        """The lines of the graph with all edges turned round."""
        turned = self.crossings.select(F.col("to_line").alias("line"), (-F.col("to_rank")).alias("rank"), F.col("line").alias("to_line"), (-F.col("rank")).alias("to_rank"))
        return Lines(self.places.withColumn("rank", -F.col("rank")), turned)

    def reached(self, starts: DataFrame, down: bool = False) -> DataFrame:
        """key, node: for each key of starts (key, node) the nodes and all their ancestors, or descendants; edges within a line are rank after rank."""
        own = self._turned() if down else self
        rounds = Rounds(starts.sparkSession, "reached")

        def changed(state: DataFrame) -> DataFrame:
            news = state.filter("new").withColumnRenamed("line", "from_line")
            passed = news.join(own.crossings, (F.col("from_line") == F.col("line")) & (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("at")))
            found = passed.groupBy("key", F.col("to_line").alias("line")).agg(F.max("to_rank").alias("found"))
            now, before = F.greatest("at", "found"), F.coalesce("at", F.lit(_NOWHERE))
            return state.drop("new", "before").join(found, ["key", "line"], "full").select("key", "line", now.alias("at"), before.alias("before"), (now > before).alias("new"))

        state = starts.join(own.places, "node").groupBy("key", "line").agg(F.max("rank").alias("at"))
        state = rounds.write(state.withColumn("before", F.lit(_NOWHERE)).withColumn("new", F.lit(True)))
        while not state.filter("new").isEmpty():
            for _ in range(_CHANGES):
                state = changed(state)
            state = rounds.write(state)
            rounds.keep_last(1)
        inside = own.places.join(state.select("key", F.col("line").alias("on_line"), "at"), (F.col("line") == F.col("on_line")) & (F.col("rank") <= F.col("at"))).select("key", "node")
        return inside.unionAll(starts.join(own.places, "node", "left_anti").select("key", "node").distinct())


def _one(starts: DataFrame) -> DataFrame:
    return starts.select(F.lit(0).alias("key"), "node")


def ancestors_or_self(parents: DataFrame | Lines, starts: DataFrame) -> DataFrame:
    """parents: node, parent (and pos), or the lines made of them."""
    return Lines.of(parents).reached(_one(starts)).select("node")


def descendants_or_self(parents: DataFrame | Lines, starts: DataFrame) -> DataFrame:
    return Lines.of(parents).reached(_one(starts), down=True).select("node")


def inherited_phase(parents: DataFrame | Lines, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """node, phase: the largest phase declared at the node or at any ancestor (0 if none).  roots: node, phase."""
    hits = Lines.of(parents).reached(roots.filter("phase > 0").select(F.col("phase").alias("key"), "node"), down=True)
    values = hits.groupBy("node").agg(F.max("key").alias("value"))
    return nodes.select("node").join(values, "node", "left").select("node", F.coalesce("value", F.lit(0)).alias("phase"))


def published(parents: DataFrame | Lines, nodes: DataFrame, obsolete: DataFrame, pinned: DataFrame, phases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """visible: ancestors or selves of nodes that are pinned or not obsolete; served: visible ones that are public or draft."""
    live = nodes.join(obsolete, "node", "left_anti").unionAll(pinned.select("node")).distinct()
    visible = written(ancestors_or_self(parents, live), "visible")
    return visible, visible.join(phases.filter("phase >= 2"), "node", "left_anti")


def exclusive(parents: DataFrame | Lines, dropped_tips: DataFrame, carried_tips: DataFrame) -> DataFrame:
    """node: reachable from a dropped tip and from no carried one."""
    tips = dropped_tips.select(F.lit(0).alias("key"), "node").unionAll(carried_tips.select(F.lit(1).alias("key"), "node"))
    return Lines.of(parents).reached(tips).groupBy("node").agg(F.max("key").alias("key")).filter("key = 0").select("node")


def exclusive_count(parents: DataFrame | Lines, dropped_tips: DataFrame, carried_tips: DataFrame) -> int:
    return exclusive(parents, dropped_tips, carried_tips).count()


_PLACES = "key long, rank long, position long"


def _heap_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of ranks in the smallest order that has parents first, a group (key) after another.

    Rows key, parent, child come sorted; a group's first one has parent -1 and its number of nodes as child.  A group is
    held as flat arrays of numbers: what each node waits for, and its children.
    """
    key, n, parents, children = None, 0, [], []

    def placed() -> Iterator[pd.DataFrame]:
        above, below = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (parents, children))
        starts = memoryview(np.concatenate([[0], np.cumsum(np.bincount(above, minlength=n))]))
        waits = np.bincount(below, minlength=n).astype(np.int32)
        roots = memoryview(np.flatnonzero(waits == 0))
        waits, below = memoryview(waits), memoryview(below)
        ready, at, out, total = [], 0, [], 0
        while ready or at < len(roots):
            if ready and (at == len(roots) or ready[0] < roots[at]):
                i = heapq.heappop(ready)
            else:
                i, at = roots[at], at + 1
            out.append(i)
            for j in range(starts[i], starts[i + 1]):
                c = below[j]
                waits[c] -= 1
                if not waits[c]:
                    heapq.heappush(ready, c)
            if len(out) == 1 << 17:
                yield pd.DataFrame({"key": key, "rank": out, "position": range(total, total + len(out))})
                total, out = total + len(out), []
        if total + len(out) < n:
            raise ValueError("the revision graph has a cycle")
        yield pd.DataFrame({"key": key, "rank": np.array(out, np.int64), "position": np.arange(total, total + len(out))})

    for pdf in batches:
        keys, up, child = (pdf[c].to_numpy() for c in ("key", "parent", "child"))
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi and up[lo] < 0:
                if key is not None:
                    yield from placed()
                key, n, parents, children, lo = int(keys[lo]), int(child[lo]), [], [], lo + 1
            parents.append(up[lo:hi].astype(np.int32))
            children.append(child[lo:hi].astype(np.int32))
    if key is not None:
        yield from placed()


def topological_order(nodes: DataFrame, groups: str | None = None) -> DataFrame:
    """node, position: the smallest order by (source, node) that has parents first.

    nodes: node, source, parents (array).  Parents outside count as met.  Nodes are numbered by (source, node) first;
    where all parents have a lower number than their children, that is the order.  Otherwise it is sequential by
    definition, so a group (repository) is one task, over numbers only; a cycle raises an error.
    """
    from .frames import running

    # a null group is one too
    at = F.coalesce(F.concat(F.lit("="), F.col(groups).cast("string")), F.lit("")) if groups else F.lit("one")
    own = nodes.select(at.alias("group"), "node", "source", "parents")
    ranked = written(running(own, ["group", "source", "node"], rank=F.lit(1)), "ranked")
    keys = ranked.groupBy("group").agg(F.min("rank").alias("key"), F.count(F.lit(1)).alias("n"))
    named = ranked.select("group", F.col("node").alias("parent"), F.col("rank").alias("above"))
    edges = ranked.select("group", "rank", F.explode("parents").alias("parent")).join(named, ["group", "parent"])
    edges = written(edges.select("group", "above", "rank"), "order-edges")
    if edges.filter("above >= rank").isEmpty():
        out = ranked.join(keys.select("group", "key"), "group").withColumn("position", F.col("rank") - F.col("key"))
    else:
        rows = edges.join(keys, "group").select("key", (F.col("above") - F.col("key")).alias("parent"), (F.col("rank") - F.col("key")).alias("child"))
        rows = rows.unionAll(keys.select("key", F.lit(-1).cast("long"), "n"))
        rows = (rows.repartition("key") if groups else rows.coalesce(1)).sortWithinPartitions("key", "parent", "child")
        placed = rows.mapInPandas(_heap_order, _PLACES).select((F.col("key") + F.col("rank")).alias("rank"), "position")
        out = ranked.join(placed, "rank")
    return out.select(F.when(F.col("group") != "", F.expr("substring(group, 2)")).alias(groups), "node", "position") if groups else out.select("node", "position")


def remapped_parents(parents: DataFrame, removed: DataFrame) -> DataFrame:
    """node, parents: parents in order, removed ones replaced by their own (transitively), each kept once.

    parents: node, pos, parent.  Rounds substitute removed parents until none is left, and hold only the edges that led
    to one; all others are read once, with the result.  Of several ways to one parent the first in order counts, and
    only that one is followed, so merges cost no more than their edges; a cycle of removed nodes raises an error.
    """
    rounds = Rounds(parents.sparkSession, "parents")
    first = lambda df: df.groupBy("node", "parent").agg(F.min("way").alias("way"))
    removed = written(removed.select("node").distinct(), "removed")
    gone = removed.select(F.col("node").alias("parent"))
    own = parents.join(removed, "node", "left_semi").select(F.col("node").alias("parent"), F.col("pos").cast("int").alias("step"), F.col("parent").alias("next")).filter("next is not null")
    way = F.array(F.col("pos").cast("int")).alias("way")
    now = rounds.write(first(parents.join(gone, "parent", "left_semi").select("node", way, "parent")).withColumn("gone", F.lit(True)))
    settled = parents.join(gone, "parent", "left_anti").select("node", way, "parent")
    if not now.isEmpty():
        own = written(own, "removed-parents")
    for _ in range(removed.count() + 1):
        if now.filter("gone").isEmpty():
            break
        moved = now.filter("gone").join(own, "parent").select("node", F.concat("way", F.array("step")).alias("way"), F.col("next").alias("parent"))
        now = rounds.write(first(moved).join(gone.withColumn("gone", F.lit(True)), "parent", "left").select("node", "parent", "way", "gone"))
        settled = settled.unionAll(now.filter("gone is null").select("node", "way", "parent"))
    else:
        raise ValueError("the removed revisions have a cycle")
    ways = settled.join(removed, "node", "left_anti").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("way", "parent"))).alias("ways"))
    names = F.transform("ways", lambda x: x["parent"])
    return ways.select("node", F.array_distinct(names).alias("parents"))


def branch_waves(wants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """imported (name, parent, wave) and blocked (name) branches.

    wants: name, parent ('' is the main line, null no line that can be a parent).  A branch is imported with the main
    line or an imported branch as its parent, wave after wave; the rest is blocked.
    """
    rounds = Rounds(wants.sparkSession, "waves")
    wants = rounds.write(wants.select("name", "parent"))
    wave, imported = 1, rounds.write(wants.filter("parent = ''").withColumn("wave", F.lit(1)))
    last = imported
    while not last.isEmpty():
        wave += 1
        above = last.select(F.col("name").alias("parent"))
        last = rounds.write(wants.filter("name <> parent").join(above, "parent", "left_semi").select("name", "parent", F.lit(wave).alias("wave")))
        imported = imported.unionAll(last)
    return imported, wants.select("name").join(imported, "name", "left_anti")
