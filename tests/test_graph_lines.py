"""Reachability and replay by lines against plain walks."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalspark.operators import graph, verify
from annalspark.storage import Rounds


def _walk(edges, starts):
    ways = {}
    for a, b in edges:
        ways.setdefault(a, []).append(b)
    seen, stack = set(starts), list(starts)
    while stack:
        for y in ways.get(stack.pop(), ()):
            if y not in seen:
                seen.add(y)
                stack.append(y)
    return seen


def _ids(df):
    rows = [r["node"] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _table(spark, edges, pos=True):
    seen, rows = {}, []
    for a, b in edges:
        seen[a] = seen.get(a, -1) + 1
        rows.append((a, b, seen[a]))
    df = spark.createDataFrame(rows, "node int, parent int, pos int")
    return df if pos else df.drop("pos")


def _named(rng, edges):
    names = list(range(max(map(max, edges)) + 1))
    rng.shuffle(names)
    return [(names[a], names[b]) for a, b in edges], names


def _history(rng, n):
    """A main line whose side branches fork, nest and merge back; the first parent of some merges is the branch."""
    edges, extra = [], n
    for i in range(1, n):
        own = [(i, i - 1)]
        if rng.random() < 0.15:
            p = rng.randrange(i)
            for _ in range(rng.randrange(1, 4)):
                edges.append((extra, p))
                p, extra = extra, extra + 1
            own.append((i, p))
        rng.shuffle(own)
        edges += own
    return edges


@pytest.mark.parametrize("pos", [True, False])
def test_reachability_equals_a_walk(spark, pos):
    rng = random.Random(1)
    edges, names = _named(rng, _history(rng, 120) + [(400, 401), (402, 401)])
    lines = graph.Lines.of(_table(spark, edges, pos))
    placed = lines.places.collect()
    assert len({(r["line"], r["rank"]) for r in placed}) == len(placed) == len({x for e in edges for x in e})
    back = [(b, a) for a, b in edges]
    for starts in ([names[119]], [names[60], names[130]], [names[402], 9999], []):
        table = spark.createDataFrame([(s,) for s in starts], "node int")
        assert _ids(graph.ancestors_or_self(lines, table)) == _walk(edges, starts)
        assert _ids(graph.descendants_or_self(lines, table)) == _walk(back, starts)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)).filter(lambda e: e[0] > e[1]), min_size=1, max_size=30), st.sets(st.integers(0, 14), max_size=3))
def test_any_graph_equals_a_walk(spark, edges, starts):
    table = spark.createDataFrame([(s,) for s in starts], "node int")
    lines = graph.Lines.of(_table(spark, edges))
    assert _ids(graph.ancestors_or_self(lines, table)) == _walk(edges, starts)
    assert _ids(graph.descendants_or_self(lines, table)) == _walk([(b, a) for a, b in edges], starts)


def test_deep_merge_graphs_take_few_rounds(spark, monkeypatch):
    rng, writes, write = random.Random(2), [], Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df: writes.append(1) or write(self, df))
    leaves = [(i, 5000 + i) for i in range(1, 4000) if i % 3 == 0] + [(i, i - 1) for i in range(1, 4000)]
    for edges, tip in ((_history(rng, 4000), 3999), (leaves, 3999)):
        edges, names = _named(rng, edges)
        writes.clear()
        found = graph.ancestors_or_self(_table(spark, edges), spark.createDataFrame([(names[tip],)], "node int"))
        assert _ids(found) == _walk(edges, [names[tip]])
        assert len(writes) <= 60


def test_phases_and_exclusive_revisions_on_merges(spark):
    rng = random.Random(3)
    edges, names = _named(rng, _history(rng, 80))
    back = [(b, a) for a, b in edges]
    nodes = sorted({x for e in edges for x in e})
    roots = [(names[10], 1), (names[40], 2), (names[85], 1), (names[85], 3), (names[3], 0)]
    want = {n: max([p for r, p in roots if n in _walk(back, [r])], default=0) for n in nodes}
    parents = _table(spark, edges)
    found = graph.inherited_phase(parents, spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(roots, "node int, phase int"))
    assert {r["node"]: r["phase"] for r in found.collect()} == want
    at = lambda *x: spark.createDataFrame([(names[i],) for i in x], "node int")
    assert _ids(graph.exclusive(parents, at(79, 90), at(70, 84))) == _walk(edges, [names[79], names[90]]) - _walk(edges, [names[70], names[84]])


def test_a_cycle_of_first_parents_is_an_error(spark):
    ring = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0)], "node int, parent int, pos int")
    with pytest.raises(ValueError, match="cycle"):
        graph.Lines.of(ring)


def test_no_edges(spark):
    none = spark.createDataFrame([], "node int, parent int, pos int")
    assert _ids(graph.ancestors_or_self(none, spark.createDataFrame([(4,)], "node int"))) == {4}


def test_many_heads_have_one_row_an_atom(spark):
    """Heads that fork from every place of a long line: lines keep one row per node and change seldom."""
    links = [(i, i - 1) for i in range(1, 600)] + [(1000 + i, i) for i in range(600)]
    nodes = spark.createDataFrame([(n,) for n in sorted({x for e in links for x in e})], "node int")
    places = graph.heavy_lines(nodes, spark.createDataFrame(links, "node int, up int")).collect()
    assert len(places) == 1200
    assert max(r["rank"] for r in places) == 600


def test_replay_on_branches_equals_walks(spark):
    rng = random.Random(4)
    up = {n: (n - 1 - rng.randrange(min(n, 9)) if rng.random() < 0.97 else None) for n in range(1, 300)} | {0: None}
    ops = {(n, rng.randrange(12)): rng.choice(["Add", "Add", "Modify", "Replace", "Delete"]) for n in range(300) for _ in range(2)}
    want = set()
    for (n, path), op in ops.items():
        at, state = up[n], None
        while at is not None and state is None:
            state = ops.get((at, path)) if ops.get((at, path)) in ("Add", "Delete") else None
            at = up[at]
        if (op == "Add") == (state == "Add"):
            want.add((n, path, op))
    found = verify.misfits(
        spark.createDataFrame([(n, p, o) for (n, p), o in ops.items()], "node int, path int, op string").withColumn("rank", F.lit(1)),
        spark.createDataFrame([(n,) for n in up], "node int"),
        spark.createDataFrame([(n, p) for n, p in up.items() if p is not None], "node int, up int"),
    )
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_nodes_at_their_root_are_not_joined_by_a_null_key(spark, monkeypatch):
    """Rows whose way has ended have no key to look up; in a join they would all fall to one task."""
    from annalspark.operators import graph as g
    from annalspark.storage import Rounds

    plans, write = [], Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(self, df))
    nodes = spark.range(6).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3)], "node long, up long")
    found = {tuple(r) for r in g._grown(nodes, links, True, 5).select("node", "root", "depth", "size").collect()}
    assert found == {(0, 0, 0, 5), (1, 0, 1, 4), (2, 0, 2, 3), (3, 0, 3, 2), (4, 0, 4, 1), (5, 5, 0, 1)}
    assert len(plans) > 1 and all("isnotnull(up" in p for p in plans[1:])
    assert all(p.count("isnull(up") >= 2 and "Union" in p for p in plans[1:])


@pytest.mark.parametrize("near", [True, False])
def test_links_are_followed_inside_stretches(spark, monkeypatch, near):
    """A deep graph whose parents are near leaves few nodes to the jumps, and its result depends on no stretch."""
    states, doubled = [], graph._doubled
    monkeypatch.setattr(graph, "_doubled", lambda state, *a: states.append(state.count()) or doubled(state, *a))
    monkeypatch.setattr(graph, "_STRETCH", 300)
    rng, n = random.Random(5), 3000
    names = [10**17 + 7 * x for x in range(n)]  # more digits than a double holds
    rng.shuffle(names)
    up = {i: i - 1 - rng.randrange(min(i, 6)) for i in range(1, n) if i % 1500}
    table = spark.createDataFrame([(names[i], i) for i in range(n)], "node long, near long")
    links = spark.createDataFrame([(names[i], names[j]) for i, j in up.items()], "node long, up long")
    root, depth, size = {}, {}, [1] * n
    for i in range(n):
        root[i], depth[i] = (root[up[i]], depth[up[i]] + 1) if i in up else (i, 0)
    for i in reversed(range(n)):
        if i in up:
            size[up[i]] += size[i]
    found = graph._grown(table if near else table.drop("near"), links, True, 14).select("node", "root", "depth", "size").collect()
    assert {tuple(r) for r in found} == {(names[i], names[root[i]], depth[i], size[i]) for i in range(n)} and len(found) == n
    if near:
        assert max(states) <= 150
        edges = [(i, j, 0) for i, j in up.items()] + [(i, i - 5, 1) for i in range(20, n, 5) if i % 1500 > 10]
        parents = spark.createDataFrame([(names[i], names[j], pos, i) for i, j, pos in edges], "node long, parent long, pos int, near long")
        starts = spark.createDataFrame([(names[1400],)], "node long")
        assert _ids(graph.ancestors_or_self(parents, starts)) == {names[i] for i in _walk([e[:2] for e in edges], [1400])}
        assert _ids(graph.descendants_or_self(parents, starts)) == {names[i] for i in _walk([(b, a) for a, b, _ in edges], [1400])}
        assert max(states) <= 150


def test_a_long_cycle_of_first_parents_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(graph, "_STRETCH", 200)
    for ring in ([(i, i % 1500 + 1) for i in range(1, 1501)], [(i, i + 1) for i in range(1, 1500)] + [(1500, 1490)]):
        with pytest.raises(ValueError, match="cycle"):
            graph.Lines.of(spark.createDataFrame(ring, "node int, parent int"))
