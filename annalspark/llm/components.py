"""Connected components of an edge table: every node's smallest reachable node.

Edges are first reduced to spanning forests inside each partition.  If what is left is within `task_edges` (a bound
that is checked), one executor task joins the forests; beyond it, rounds of "hang every node under its smallest
neighbour, pass its other edges on, halve the paths" run until nothing changes.  Nothing goes to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages

EDGES = "u long, v long"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges and its component's smallest node, without the smallest nodes themselves."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
        if not len(a):
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u = v = np.zeros(0, np.int64)
    for b in batches:
        u, v = np.concatenate([u, b.column(0).to_numpy()]), np.concatenate([v, b.column(1).to_numpy()])
        if len(u) > 4_000_000:
            u, v = forest(u, v)
    u, v = forest(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(edges: DataFrame, stages: Stages, name: str, task_edges: int = 2_000_000) -> DataFrame:
    """node, component for every node of an edge (u, v) whose component is another node."""
    now = stages.write(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(_local, EDGES), f"{name}-0")
    if now.count() <= task_edges:
        return stages.write(now.repartition(1).mapInArrow(_local, EDGES).select(F.col("u").alias("node"), F.col("v").alias("component")), f"{name}-end")
    return stages.write(_rounds(now, stages, name), f"{name}-end")


def _rounds(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    step = 0
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    while True:
        step += 1
        parent = now.groupBy("u").agg(F.min("v").alias("p"))
        tree = stages.write(parent, f"{name}-{step}-tree")
        passed = now.join(tree, "u").filter("v <> p").select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v"))
        up = tree.select(F.col("u").alias("p"), F.col("p").alias("q"))
        halved = tree.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("v"))
        now = stages.write(halved.unionAll(passed).distinct(), f"{name}-{step}")
        count, nodes = now.count(), tree.count()
        deep = now.alias("a").join(now.select(F.col("u").alias("x")).alias("b"), F.col("a.v") == F.col("b.x"), "left_semi").limit(1).count()
        if step > 1:
            stages.drop(f"{name}-{step - 1}", f"{name}-{step - 1}-tree")
        if count == nodes and not deep:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
