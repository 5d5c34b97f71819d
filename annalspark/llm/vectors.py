"""Embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors are one class (its smallest id and its number of rows), so a vector that fills a third of the table
   is one point of the graph.
2. Centroids from a bounded hash sample cut the points into shards, and shards that are still large are cut again by
   centroids of their own, so the number of shards grows with the points; every point is built into its `overlap` nearest
   shards.  In each shard candidates of a point are pruned robustly (an edge is dropped when a kept neighbour is
   `alpha` times nearer to its end), a few nearest neighbours and all reverse edges are added, and the adjacency lists
   of a point from its shards are united.
3. Every point is a query in its `probes` nearest shards: greedy beam search from the shard's medoid, then the range is
   expanded over the graph from every hit until no further point within it is found.  Cosines that decide are computed
   in double precision, so no link is below the threshold.  A point is counted only in its home shard, so no pair is
   counted twice and pairs need not be written: a shard gives link counts and a spanning forest.
4. Recall is audited: a bounded number of queries is compared with all points by brute force.  Only links between
   different points count, one each: no query finds itself, and copies of a vector are one point.  Queries are drawn
   until enough of them have such links, or the bound is reached.  Below `recall` the beam and the probes are doubled
   and the search repeated; if the last round is below `least_recall`, the call fails.  `last_audit` holds the figures;
   its recall is None, unmeasured, where no query that was drawn has a link.

What even two levels of centroids cannot cut (very many vectors close to each other) is cut into pieces by hash that all
its queries visit, so a task's memory is bounded whatever the clustering.

Cases: null vectors, zero ones and those with null, NaN or infinite components link with nothing and are kept; vectors
of different lengths have no cosine, so every length is a table of its own; repeated ids are separate rows with equal
results; rows without an id are nobody's partner and report the links of their vector; empty tables give no rows; ties
have no effect (links are a threshold, components take the smallest id); extra columns and labels are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages
from .components import components, forest


@dataclass(frozen=True)
class GraphParams:
    threshold: float = 0.9
    sample: int = 20_000
    shard_points: int = 1500
    #: Centroids are at most one per so many sampled vectors.
    per_centroid: int = 20
    shard_rows: int = 4096
    overlap: int = 2
    probes: int = 4
    degree: int = 24
    nearest: int = 6
    alpha: float = 1.2
    beam: int = 32
    #: Queries of an audit, at least and at most, and the links that are enough.
    audit: int = 200
    audit_most: int = 3200
    audit_links: int = 400
    recall: float = 0.97
    least_recall: float = 0.9
    rounds: int = 3


last_audit: dict[str, float | None] = {}


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow."""
    x = raw.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread starts."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def prune(v: np.ndarray, p: GraphParams) -> list[np.ndarray]:
    """Robust-pruned adjacency of the points of one shard piece, reverse edges included."""
    n = len(v)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    width = min(n - 1, 4 * p.degree)
    out: list[list[int]] = [[] for _ in range(n)]
    for lo in range(0, n, 512):
        dist = 2 - 2 * (v[lo : lo + 512] @ v.T)  # squared distances of unit vectors
        dist[np.arange(len(dist)), np.arange(lo, lo + len(dist))] = np.inf
        cand = np.argpartition(dist, width - 1, axis=1)[:, :width]
        cand = np.take_along_axis(cand, np.argsort(np.take_along_axis(dist, cand, 1), axis=1, kind="stable"), 1)
        for i, c in enumerate(cand):
            d = dist[i, c]
            among = 2 - 2 * (v[c] @ v[c].T)
            alive, kept = np.ones(len(c), bool), []
            for j in range(len(c)):
                if alive[j]:
                    kept.append(j)
                    if len(kept) >= p.degree:
                        break
                    alive &= p.alpha**2 * among[j] > d
            out[lo + i] = c[sorted({*kept, *range(min(p.nearest, len(c)))})].tolist()
    back: list[list[int]] = [[] for _ in range(n)]
    for i, a in enumerate(out):
        for j in a:
            back[j].append(i)
    lists = []
    for i, (a, b) in enumerate(zip(out, back, strict=True)):
        if len(b) > 2 * p.degree:  # a hub: its nearest reverse edges; the others still lead to it
            b = np.array(b)[np.argsort(-(v[b] @ v[i]), kind="stable")[: 2 * p.degree]].tolist()
        lists.append(np.array(sorted({*a, *b}), np.int64))
    return lists


def search(v: np.ndarray, graph: np.ndarray, q: np.ndarray, p: GraphParams, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs within the threshold: beam search for all queries at once, then range expansion.

    graph: padded adjacency (-1); v, q: unit rows in double precision.
    """
    n, m = len(v), len(q)
    v4, q4 = v.astype(np.float32), q.astype(np.float32)
    seen = np.zeros((m, n), bool)
    beam = p.beam
    ids, sim = np.zeros((m, beam), np.int64), np.full((m, beam), -np.inf, np.float32)
    ids[:, : len(entries)], sim[:, : len(entries)] = entries, q4 @ v4[entries].T
    seen[:, entries] = True
    done = np.zeros((m, n), bool)
    rows = np.arange(m)
    while len(rows):
        open_sim = np.where(done[rows[:, None], ids[rows]] | ~np.isfinite(sim[rows]), -np.inf, sim[rows])
        best = open_sim.argmax(1)
        go = open_sim[np.arange(len(rows)), best] > -np.inf
        rows, best = rows[go], best[go]
        if not len(rows):
            break
        at = ids[rows, best]
        done[rows, at] = True
        near = graph[at]
        ok = near >= 0
        ok &= ~seen[rows[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(ok)
        node = near[r, c]
        new_sim = np.full(near.shape, -np.inf, np.float32)
        new_sim[r, c] = np.einsum("ij,ij->i", v4[node], q4[rows[r]])
        seen[rows[r], node] = True
        every, score = np.concatenate([ids[rows], np.maximum(near, 0)], 1), np.concatenate([sim[rows], new_sim], 1)
        top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        ids2, sim2 = np.take_along_axis(every, top, 1), np.take_along_axis(score, top, 1)
        ids[rows], sim[rows] = ids2, sim2
    # everything seen in range starts the expansion
    margin = p.threshold - 1e-4
    r, c = np.nonzero(sim >= margin)
    a, b = r, ids[r, c]
    hit = np.zeros((m, n), bool)
    hit[a, b] = True
    while len(a):
        new_a, new_b = [], []
        for lo in range(0, len(a), 20_000):  # slices bound the memory, however many points are in range
            near = graph[b[lo : lo + 20_000]]
            r, c = np.nonzero(near >= 0)
            key = np.unique(a[lo : lo + 20_000][r] * n + near[r, c])
            key = key[~hit.reshape(-1)[key]]
            for k in range(0, len(key), 100_000):
                qa, node = key[k : k + 100_000] // n, key[k : k + 100_000] % n
                good = np.einsum("ij,ij->i", v4[node], q4[qa]) >= margin
                hit[qa[good], node[good]] = True
                new_a.append(qa[good])
                new_b.append(node[good])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (new_a, new_b))
    a, b = np.nonzero(hit)
    exact = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], v[b[i : i + 65536]]) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
    return a[exact >= p.threshold], b[exact >= p.threshold]


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(-1, dim)


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and data of the vectors that can link."""
    e = F.col("embedding").cast("array<double>")
    fine = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(e).alias("dim"), F.transform(e, lambda x: x + F.lit(0.0)).alias("data"))


def link(vectors: DataFrame, params: GraphParams = GraphParams()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    stages = Stages(spark, "vectors")
    usable = _usable(vectors)
    found, tables = None, []
    for dim in sorted(r[0] for r in usable.select("dim").distinct().collect()):  # a row per length
        one = stages.write(_of_length(usable.filter(F.col("dim") == dim), dim, params, stages), f"final-{dim}")
        tables.append(f"final-{dim}")
        found = one if found is None else found.unionAll(one)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("data"))
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    stages.retain(*tables)
    # null vectors, however many, are no key: each gets one of its own, by its id
    out = rows.withColumn("key", F.coalesce(F.xxhash64("data"), F.lit(0)) + F.when(F.col("data").isNull(), F.coalesce("vec_id", F.lit(0))).otherwise(F.lit(0)))
    out = out.join(found.withColumn("key", F.xxhash64("data")), ["key", "data"], "left")
    return out.select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"))


def _of_length(usable: DataFrame, dim: int, params: GraphParams, stages: Stages) -> DataFrame:
    """data, links (copies within range, own ones included) and component of every different vector of one length."""
    points = stages.write(usable.groupBy("data").agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("copies")).withColumn("hash", F.xxhash64("data")), f"points-{dim}")
    n = points.count()
    some = points if n <= params.sample else points.filter(F.pmod("hash", F.lit(1_000_000)) < int(1_000_000 * params.sample / n))
    sample = np.array([r[0] for r in some.orderBy("hash", "point").limit(params.sample + params.sample // 10).select("data").collect()])
    sample = unit(sample if len(sample) else np.array([points.select("data").first()[0]]))
    c = centroids(sample, max(1, min(-(-n // params.shard_points), len(sample) // params.per_centroid)))
    p = params
    for k in range(params.rounds):
        links, edges = _search_all(points, c, dim, n, p, stages)
        share = _audit(points, links, dim, n, p)
        if share is None or share >= p.recall:
            break
        if k + 1 < params.rounds:
            p = replace(p, beam=2 * p.beam, probes=2 * p.probes, overlap=2 * p.overlap)
    if share is not None and share < params.least_recall:
        raise RuntimeError(f"the audited recall of vectors of length {dim} stays at {share:.3f}, below {params.least_recall}: {last_audit}")
    labels = components(edges, stages, f"components-{dim}")
    named = points.join(links, "point", "left").join(labels.withColumnRenamed("node", "point"), "point", "left")
    return named.select("data", F.coalesce("links", "copies").alias("links"), F.coalesce("component", "point").alias("component"))


def _route(points: DataFrame, c: np.ndarray, dim: int, near: int, stages: Stages, name: str, p: GraphParams) -> DataFrame:
    """shard, rank, point, copies, data (unit vector) for the nearest shards of every point."""
    shared = points.sparkSession.sparkContext.broadcast(c)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            x = unit(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            score = x @ shared.value.T
            take = min(near, score.shape[1])
            top = np.argsort(-score, axis=1, kind="stable")[:, :take]
            for rank in range(take):
                yield pa.RecordBatch.from_arrays([pa.array(top[:, rank].astype(np.int64)), pa.array(np.full(len(x), rank)), batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(3)], names=["shard", "rank", "point", "copies", "data", "hash"])

    return stages.write(points.select("point", "copies", "data", "hash").mapInArrow(run, "shard long, rank long, point long, copies long, data binary, hash long"), name)


def _cut_again(routed: DataFrame, dim: int, p: GraphParams, stages: Stages, tag: str) -> DataFrame:
    """shard, point, copies, data, hash and what the point does there: build, ask, home.  Large shards are cut by centroids of their own."""
    flags = lambda sub: (((F.col("rank") < p.overlap) & (sub < p.overlap)).alias("build"), ((F.col("rank") < p.probes) & (sub < p.probes)).alias("ask"), ((F.col("rank") == 0) & (sub == 0)).alias("home"))
    size = routed.filter(F.col("rank") < p.overlap).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    large = stages.write(size.filter(F.col("n") > 2 * p.shard_rows).select("shard", "n", F.least(F.ceil(2 * F.col("n") / p.shard_rows), F.lit(1000)).cast("long").alias("subs"), F.ceil(F.col("n") / p.shard_rows).cast("long").alias("salts")), f"large-{tag}")
    whole = ["shard", "point", "copies", "data", "hash"]
    if large.isEmpty():
        return routed.select(*whole, *flags(F.lit(0)))
    small = routed.join(large.select("shard"), "shard", "left_anti").select(*whole, *flags(F.lit(0)))
    rows = routed.join(large, "shard")
    # a sample of about `per_centroid` points for each new centroid
    some = rows.filter((F.col("rank") < p.overlap) & (F.pmod(F.xxhash64("hash"), F.greatest(F.lit(1), F.floor(F.col("n") / (p.per_centroid * F.col("subs"))))) == 0))

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(pdf.sort_values("point", kind="stable")["data"], dim)
        c = centroids(v, min(int(pdf["subs"].iloc[0]), max(1, len(v) // 4)))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "means": [c.tobytes()]})

    subs = some.select("shard", "subs", "point", "data").groupBy("shard").applyInPandas(means, "shard long, means binary")
    subs = subs.join(large.select("shard", "salts"), "shard").select(F.col("shard").alias("of"), "means", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))

    def nearest(own: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(table):
            return pd.DataFrame({k: [] for k in (*whole, "rank", "sub")})
        score = _matrix(own["data"], dim) @ _matrix(table["means"].iloc[:1], dim).T
        take = min(max(p.probes, p.overlap), score.shape[1])
        top = np.argsort(-score, axis=1, kind="stable")[:, :take]
        out = own.loc[own.index.repeat(take), [*whole, "rank"]].assign(sub=np.tile(np.arange(take), len(own)))
        return out.assign(shard=out["shard"] * 1000 + 1_000_000 + top.ravel())

    cut = rows.withColumn("salt", F.pmod(F.xxhash64("hash", F.lit(1)), "salts")).select(*whole, "rank", F.col("shard").alias("of"), "salt")
    cut = cut.groupBy("of", "salt").cogroup(subs.groupBy("of", "salt")).applyInPandas(nearest, "shard long, point long, copies long, data binary, hash long, rank long, sub long")
    return stages.write(small.unionAll(cut.select(*whole, *flags(F.col("sub")))), f"cut-{tag}")


def _search_all(points: DataFrame, c: np.ndarray, dim: int, n: int, p: GraphParams, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """links (copies within range, own ones included) and others (different points) of every point, and spanning edges."""
    tag = f"{dim}-{p.beam}"
    routed = _cut_again(_route(points, c, dim, max(p.probes, p.overlap), stages, f"routed-{tag}", p), dim, p, stages, tag)
    build = routed.filter("build")
    pieces = build.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * p.shard_rows)).cast("long").alias("pieces"))  # a row per shard
    pieces = stages.write(pieces, f"pieces-{tag}")
    build = build.join(pieces, "shard").withColumn("piece", F.pmod("hash", "pieces"))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point", kind="stable")
        ids = pdf["point"].to_numpy()
        lists = prune(_matrix(pdf["data"], dim), p)
        return pd.DataFrame({"point": ids, "near": [ids[a] for a in lists]})

    lists = build.select("shard", "piece", "point", "data").groupBy("shard", "piece").applyInPandas(graph, "point long, near array<long>")
    union = lists.groupBy("point").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    members = stages.write(build.join(union, "point").select("shard", "piece", "point", "copies", "home", "data", "near"), f"members-{tag}")
    queries = routed.filter("ask").join(pieces, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    # a piece's queries come in slices of bounded size, each with the piece's graph
    per = queries.groupBy("shard", "piece").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * p.shard_rows)).cast("long").alias("slices"))
    per = stages.write(per, f"slices-{tag}")
    key = ["shard", "piece", "slice"]
    left = members.join(per, ["shard", "piece"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    right = queries.select("shard", "piece", "point", "data", "hash").join(per, ["shard", "piece"]).withColumn("slice", F.pmod("hash", "slices"))

    def visit(_key: tuple, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"kind": [], "a": [], "b": [], "c": []}).astype("int64")
        if not len(own) or not len(ask):
            return empty
        own = own.sort_values("point", kind="stable").reset_index(drop=True)
        ids, v = own["point"].to_numpy(np.int64), _matrix(own["data"], dim)
        lists = []
        for a in own["near"]:
            a = np.asarray(a, np.int64)
            lists.append(np.searchsorted(ids, a[np.isin(a, ids)]))
        width = max(1, max(map(len, lists)))
        padded = np.full((len(ids), width), -1, np.int64)
        for i, a in enumerate(lists):
            padded[i, : len(a)] = a
        mean = v.mean(0)
        medoid = int((v @ mean).argmax())
        entries = np.unique(np.concatenate([[medoid], np.linspace(0, len(ids) - 1, min(p.beam, len(ids))).astype(np.int64)]))
        entries = np.concatenate([[medoid], entries[entries != medoid]])[: min(p.beam, len(ids))]
        home, copies = own["home"].to_numpy(bool), own["copies"].to_numpy(np.int64)
        links, others, us, vs = np.zeros(len(ask), np.int64), np.zeros(len(ask), np.int64), [], []
        asked = ask["point"].to_numpy(np.int64)
        for lo in range(0, len(ask), 512):
            a, b = search(v, padded, _matrix(ask["data"].iloc[lo : lo + 512], dim), p, entries)
            links[lo : lo + 512] += np.bincount(a, np.where(home[b], copies[b], 0), min(512, len(ask) - lo)).astype(np.int64)
            others[lo : lo + 512] += np.bincount(a, home[b] & (ids[b] != asked[lo + a]), min(512, len(ask) - lo)).astype(np.int64)
            u, w = forest(asked[lo + a], ids[b])
            us.append(u)
            vs.append(w)
        u, w = forest(np.concatenate(us), np.concatenate(vs))
        some = links > 0
        return pd.DataFrame({"kind": np.concatenate([np.zeros(some.sum(), np.int64), np.ones(len(u), np.int64)]), "a": np.concatenate([asked[some], u]), "b": np.concatenate([links[some], w]), "c": np.concatenate([others[some], np.zeros(len(u), np.int64)])})

    both = stages.write(left.select(*key, "point", "copies", "home", "data", "near").groupBy(*key).cogroup(right.select(*key, "point", "data").groupBy(*key)).applyInPandas(visit, "kind long, a long, b long, c long"), f"found-{tag}")
    return both.filter("kind = 0").groupBy(F.col("a").alias("point")).agg(F.sum("b").alias("links"), F.sum("c").alias("others")), both.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _audit(points: DataFrame, links: DataFrame, dim: int, n: int, p: GraphParams) -> float | None:
    """Share of the true links of some queries that were found, None where they have none; by brute force over all points.

    A link is a different point within range, whatever its copies; the query itself is none.
    """
    most, share = p.audit, None
    while True:
        asked = points.filter(F.pmod(F.xxhash64("point"), F.lit(max(1, n // most))) == 0).orderBy(F.xxhash64("point"), "point").limit(most)
        asked = asked.join(links, "point", "left").select("point", "data", F.coalesce("others", F.lit(0)).alias("others")).collect()
        q, ids = unit(np.array([r["data"] for r in asked])), np.array([r["point"] for r in asked])
        shared = points.sparkSession.sparkContext.broadcast((q, ids))

        def run(stream: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, ids = shared.value
            total = np.zeros(len(q), np.int64)
            for batch in stream:
                if batch.num_rows:
                    x = unit(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                    other = ids[:, None] != batch.column(1).to_numpy()[None]
                    for k in range(0, len(q), 256):
                        total[k : k + 256] += ((q[k : k + 256] @ x.T >= p.threshold) & other[k : k + 256]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["q", "n"])

        truth = np.zeros(len(q), np.int64)
        for r in points.select("data", "point").mapInArrow(run, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect():
            truth[r["q"]] = r["n"]
        if truth.sum() >= p.audit_links or most >= min(n, p.audit_most):
            break
        most = min(4 * most, p.audit_most)
    got = np.minimum(np.array([r["others"] for r in asked]), truth)
    share = float(got.sum() / truth.sum()) if truth.sum() else None
    last_audit.update(dim=dim, queries=len(q), with_links=int((truth > 0).sum()), links=int(truth.sum()), recall=share, beam=p.beam, probes=p.probes)
    return share
