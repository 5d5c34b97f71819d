"""Diffs, lookups, graph, names, reports, checks and edits on small tables."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalspark.functions import scalars as S
from annalspark.history import History
from annalspark.operators import asof, diff, graph, refs, report, transform, verify


def one(spark, value, kind="string", f=None):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (S.machine_value, "a b/c@d:e+f~g*h=%é", "a%20b/c@d:e+f~g%2Ah%3D%25%C3%A9"),
        (S.human_text, "a\\b\x1b‮é­", "a\\\\b\\u{001b}\\u{202e}é\\u{00ad}"),
        (S.strict_seconds, "-12", -12), (S.strict_seconds, "+1", None), (S.strict_seconds, "9223372036854775808", None), (S.strict_seconds, "1\n", None),
        (S.strict_offset_minutes, "-0130", -90), (S.strict_offset_minutes, "+0060", None), (S.strict_offset_minutes, "0100", None),
        (S.dump_date_seconds, "2024-02-31T99:00:00.5Z", 1709337600 + 23 * 3600 - 82800 + 99 * 3600 - 0),
        (S.rcs_date_seconds, "99.02.29.00.00.00", None), (S.rcs_date_seconds, "70.01.02.00.00.01", 86401), (S.rcs_date_seconds, "2024.02.29.23.59.60", 1709251200),
        (S.user_name, "Al <B> <al@x>", "Al <B>"), (S.user_email, "Al <B> <al@x>", "al@x"), (S.user_email, "nobody", None),
        (lambda v: S.dotted(S.parse_dotted(v)), "1.10.2", "1.10.2"), (S.parse_dotted, "1.x", None), (S.parse_dotted, "1.4294967296", None),
        (S.layout_root, "branches/x/y", "branches/x"), (S.layout_root, "trunkish", None), (S.layout_root, "branches/", None),
        (S.is_transform_name, "a-1", True), (S.is_transform_name, "A", False), (S.is_transform_drop, "ref branch x", True), (S.is_transform_drop, "atom 12", False),
        (S.symlink_target, "link a/b", "a/b"), (S.quoted_path, 'a\nb"', '"a\\nb\\""'), (S.clean_identity, "a<b>", "a b"),
    ],
)
def test_scalars(spark, f, value, want):
    got = one(spark, value, f=f)
    if f is S.dump_date_seconds:  # 31 February and hour 99 are taken as they are
        want = S_days(2024, 2, 31) * 86400 + 99 * 3600
    assert got == want


def S_days(y, m, d):
    import datetime

    return (datetime.date(y, m, 1) - datetime.date(1970, 1, 1)).days + d - 1


def test_revision_numbers(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 0, 4],), ([1, 2, 4],), ([1, 2, 4, 7],)], "r array<bigint>")
    got = df.select(S.names_branch(F.col("r")).alias("b"), S.dotted(S.magic_branch_number(F.col("r"))).alias("m"), S.dotted(S.magic_branch(F.col("r"))["branch"]).alias("u"), S.has_reachable_shape(F.col("r")).alias("s"), S.is_main_line(F.col("r"), F.array(F.lit(1), F.lit(2), F.lit(4)).cast("array<bigint>")).alias("l")).collect()
    assert [tuple(r) for r in got] == [(False, None, None, True, True), (True, None, "1.2.4", True, False), (True, "1.2.0.4", None, False, False), (False, None, None, True, True)]
    assert one(spark, b"ab\xff c", "binary", S.machine_bytes) == "ab%FF%20c"
    assert one(spark, b"first\r\nsecond", "binary", S.subject_line) == "first" and one(spark, b"\xff", "binary", S.subject_line) == ""
    assert one(spark, -90, "int", lambda v: S.rendered_time(F.lit(5), v)) == "5 -0130"


def test_diff_and_renames(spark):
    base = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", None), (1, "d", "z")], "atom int, path string, blob string")
    child = spark.createDataFrame([(1, "a", "x"), (1, "b", "q"), (1, "c", None), (1, "e", "z")], "atom int, path string, blob string")
    stated = spark.createDataFrame([(1, "a")], "atom int, path string")
    got = {r["path"]: r["op"] for r in diff.snapshot_diff(base, child, replaced=stated).collect()}
    assert got == {"a": "Replace", "b": "Modify", "d": "Delete", "e": "Add"}
    ops = diff.snapshot_diff(base, child).select("atom", "path", "op", F.coalesce("new_blob", "old_blob").alias("blob"))
    assert [(r["from_path"], r["to_path"]) for r in diff.exact_renames(ops).collect()] == [("d", "e")]
    twice = ops.unionAll(spark.createDataFrame([(1, "f", "Add", "z")], ops.schema))
    assert diff.exact_renames(twice).count() == 0
    states = spark.createDataFrame([("l", "p", 1, False), ("l", "p", 2, True), ("l", "p", 3, True), ("l", "p", 4, False)], "line string, path string, pos int, live boolean")
    assert [r["op"] for r in diff.running_ops(states).orderBy("pos").collect()] == [None, "Add", "Modify", "Delete"]


def test_asof_and_subtrees(spark):
    states = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", 5, "c")], "k string, at int, v string")
    probes = spark.createDataFrame([("k", 0, 1), ("k", 1, 2), ("k", 5, 3), ("k", 9, 4), ("q", 9, 5)], "k string, at int, id int")
    got = {r["id"]: r["v"] for r in asof.asof_last(probes, states, ["k"], "at", ["v"], tie="v").collect()}
    assert got == {1: None, 2: "a", 3: "c", 4: "c", 5: None}
    live = spark.createDataFrame([("a/b/c",), ("a/bc",), ("a/b",), ("z",)], "path string")
    copies = spark.createDataFrame([("a/b", "n/m")], "src string, dst string")
    assert {(r["path"], r["new_path"]) for r in asof.subtree_copy(live, copies).collect()} == {("a/b/c", "n/m/c"), ("a/b", "n/m")}
    gone = spark.createDataFrame([("a/b",)], "path string")
    assert {r["path"] for r in asof.without_subtrees(live, gone).collect()} == {"a/bc", "z"}
    added = spark.createDataFrame([("a",), ("q",)], "path string")
    assert [r["path"] for r in refs.empty_folders(added, live).collect()] == ["q"]


def test_graph(spark):
    edges = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (7, 6)]
    parents = spark.createDataFrame(edges, "node int, parent int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node int")
    at = lambda *x: spark.createDataFrame([(i,) for i in x], "node int")
    assert {r["node"] for r in graph.ancestors_or_self(parents, at(4)).collect()} == {1, 2, 3, 4}
    assert {r["node"] for r in graph.descendants_or_self(parents, at(2)).collect()} == {2, 4, 5}
    roots = spark.createDataFrame([(2, 1), (3, 2), (6, 1)], "node int, phase int")
    assert {r["node"]: r["phase"] for r in graph.inherited_phase(parents, nodes, roots).collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 2, 6: 1, 7: 1}
    visible, served = graph.published(parents, nodes, at(5, 7), at(7), spark.createDataFrame([(3, 2), (4, 2)], "node int, phase int"))
    assert {r["node"] for r in visible.collect()} == {1, 2, 3, 4, 6, 7} and {r["node"] for r in served.collect()} == {1, 2, 6, 7}
    assert graph.exclusive_count(parents, at(5), at(3)) == 3
    order = spark.createDataFrame([(4, 4, 0), (4, 9, 1), (9, 3, 0), (3, 1, 0), (5, 9, 0)], "node int, parent int, pos int")
    kept = graph.remapped_parents(order.select("node", "pos", "parent"), at(9))
    assert {r["node"]: list(r["parents"]) for r in kept.collect()} == {4: [4, 3], 3: [1], 5: [3]}


def test_topological_order(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 40)), sorted({int(x) for x in rng.integers(0, i, 2)}) + ([999] if i % 9 == 0 else []) if i else []) for i in range(150)]
    df = spark.createDataFrame(rows, "node int, source int, parents array<int>").repartition(3)
    got = [r["node"] for r in graph.topological_order(df).orderBy("position").collect()]
    waits = {n: sum(p < 150 for p in ps) for n, _, ps in rows}
    ready, want = [(s, n) for n, s, _ in rows if not waits[n]], []
    heapq.heapify(ready)
    while ready:
        n = heapq.heappop(ready)[1]
        want.append(n)
        for m, s, ps in rows:
            if n in ps:
                waits[m] -= 1
                if not waits[m]:
                    heapq.heappush(ready, (s, m))
    assert got == want
    with pytest.raises(Exception, match="cycle"):
        graph.topological_order(spark.createDataFrame([(1, 1, [2]), (2, 2, [1])], "node int, source int, parents array<int>")).collect()


def test_cut_points(spark):
    rows = [("e", 2, 9), ("e", 4, 7), ("s", 0, 3), ("s", 5, 9), ("s", 6, 12), ("t", 0, 1), ("t", 1, 2)]
    got = {r["branch"]: (r["position"], r["exact"], r["covered"]) for r in refs.cut_points(spark.createDataFrame(rows, "branch string, `in` int, `out` int"), 10).collect()}
    assert got == {"e": (4, True, 2), "s": (6, False, 2), "t": (0, False, 1)}


def test_percentiles(spark):
    for values in ([5], [1, 2], [1, 2, 3, 4], list(range(10)), [3] * 7 + [9] * 3):
        v, n = sorted(values), len(values)
        got = report.rank_percentiles(spark.createDataFrame([(x,) for x in values], "n int"), "n").first()
        assert tuple(got) == (v[0], v[n // 2], v[min(n * 9 // 10, n - 1)], v[-1])


@pytest.fixture(scope="module")
def small(spark):
    def status(kind=None, params=None, layers=()):
        return ("derived" if kind else "stated", (kind, None, "tool", "1", params or {}, 80) if kind else None, [(s, ["author"]) for s in layers])

    def text(b):
        return (b, None)

    ids = [bytes([i]) * 32 for i in (1, 2, 3)]
    blobs = {p: bytes.fromhex(one(spark, p, f=lambda v: F.sha2(v, 256))) for p in ("aaa", "bbb", "ccc")}
    alice = (text(b"Alice"), text(b"alice@example.com"))
    atoms = [(ids[i], i, ("git", None, b"r", ids[i]), alice, (1000 + i, 0), None, None, text(m), status()) for i, m in enumerate((b"root", b"mid", b"tip"))]
    return History.of(
        spark, atoms=atoms, parents=[(ids[1], 0, ids[0]), (ids[2], 0, ids[1])],
        ops=[(ids[i], p, "Add", blobs[b], 0o100644, status()) for i, (p, b) in enumerate((("a", "aaa"), ("b", "bbb"), ("c", "ccc")))],
        copies=[(ids[2], "a", ids[0], "a-copy", status("inferred-rename", {"rename_algorithm": "similarity", "rename_threshold": "50"}))],
        refs=[("refs/heads/main", "branch", None, ids[2], None, None, status()), ("v1", "tag", None, ids[1], None, None, status())],
        blobs=[(b, 3, p.encode()) for p, b in blobs.items()], flags=[("below-confidence-floor", "an example", 1, "r")],
        provenance=[("git", "1", "1", b"r", {})],
    )


def test_a_sound_history_passes(spark, small, tmp_path):
    state, rows = verify.verdict(small)
    assert state == "pass" and [r["check"] for r in rows] == list(verify.CHECKS)
    got = {(r["section"], r["label"]): r["n"] for r in small.report().collect()}
    assert got["derived", "inferred-rename"] == 1 and got["flagged", "below-confidence-floor"] == 1 and got["total", "content_bytes"] == 9
    assert report.exit_class(small.report()).first()["exit"] == 30
    small.write(str(tmp_path / "h"))
    again = History.read(spark, str(tmp_path / "h"))
    assert verify.against_source(again.atoms.select("atom_id", "atom_idx"), small.atoms.select("atom_id", "atom_idx")).count() == 0
    assert report.machine_atoms(small.atoms, small.ops).count() == 6 and report.machine_lines(small.report()).count() == got.__len__()


@pytest.mark.parametrize(
    ("check", "broken"),
    [
        ("structure", lambda h: h.replace(parents=h.parents.withColumn("parent_id", F.col("atom_id")))),
        ("structure", lambda h: h.replace(ops=h.ops.unionAll(h.ops.limit(1)))),
        ("structure", lambda h: h.replace(refs=h.refs.unionAll(h.refs.limit(1)))),
        ("structure", lambda h: h.replace(refs=h.refs.withColumn("target", F.unhex(F.lit("00"))))),
        ("integrity", lambda h: h.replace(blobs=h.blobs.limit(2))),
        ("integrity", lambda h: h.replace(blobs=h.blobs.withColumn("content", F.lit(b"x").cast("binary")))),
        ("replay", lambda h: h.replace(ops=h.ops.withColumn("op", F.lit("Modify")))),
        ("derivations", lambda h: h.replace(copies=h.copies.withColumn("status", F.col("status").withField("derivation.params", F.create_map().cast("map<string,string>"))))),
        ("source-invariants", lambda h: h.replace(provenance=h.provenance.withColumn("source_kind", F.lit("cvs")))),
        ("provenance", lambda h: h.replace(provenance=h.provenance.withColumn("tool_version", F.lit("")))),
        ("loss-boundary", lambda h: h.replace(drops=h.drops.sparkSession.createDataFrame([("c", "", "r", None)], h.drops.schema))),
    ],
)
def test_each_check_fails_on_one_fault(small, check, broken):
    state, rows = verify.verdict(broken(small))
    assert state == "fail" and check in {r["check"] for r in rows if r["outcome"] == "fail"}


def test_edits_are_recorded(spark, small):
    bob = F.struct(F.struct(F.lit(b"Bob").cast("binary").alias("bytes"), F.lit(None).cast("string").alias("encoding")).alias("name"), F.col("author.email").alias("email"))
    out = transform.Edit(small, "who", "1").set_author(bob, F.col("atom_idx") == 1).finish()
    marked = {r["atom_idx"]: r["status"]["layers"] for r in out.atoms.collect()}
    assert len(marked[1]) == 1 and not marked[0] and out.transforms.count() == 1
    assert verify.verdict(out)[0] == "pass"
    less = transform.Edit(small, "cut", "1").remove_atoms(F.col("atom_idx") == 1, "not wanted").finish()
    assert less.drops.first()["what"].startswith("atom 02") and [(r["pos"], bytes(r["parent_id"])[0]) for r in less.parents.collect()] == [(0, 1)]
    with pytest.raises(ValueError, match="transform name"):
        transform.Edit(small, "Bad Name", "1")
    silent = transform.Edit(small, "who", "1")
    silent.out = silent.out.replace(atoms=silent.out.atoms.withColumn("message", F.lit(None).cast(silent.out.atoms.schema["message"].dataType)))
    with pytest.raises(ValueError, match="records"):
        silent.finish()
    assert transform.register("transform", "id", lambda h: h) and not transform.register("transform", "id", lambda h: h)
    assert transform.run("transform", "id", small) is small and transform.listed("transform") == ["id"]


def test_rounds_of_removed_parents_hold_only_their_edges(spark, monkeypatch):
    """Edges that lead to no removed revision are not written round after round."""
    from annalspark import storage

    written_rows, write = [], storage.Rounds.write

    def counted(self, df):
        out = write(self, df)
        written_rows.append(out.count())
        return out

    monkeypatch.setattr(storage.Rounds, "write", counted)
    parents = spark.createDataFrame([(n, 0, n - 1) for n in range(1, 500)] + [(7, 1, 300), (9, 1, None)], "node long, pos int, parent long")
    kept = graph.remapped_parents(parents, spark.createDataFrame([(5,), (6,), (300,)], "node long"))
    found = {r["node"]: r["parents"] for r in kept.collect()}
    assert found[7] == [4, 299] and found[301] == [299] and found[9] == [8, None] and found[8] == [7]
    assert len(found) == 496 and max(written_rows) < 10


def test_topological_order_is_by_numbers_and_needs_no_task_where_parents_come_first(spark, monkeypatch):
    """Random graphs in groups equal a plain heap; an ascending graph is numbered without the sequential task."""
    import heapq
    import random

    draw, rows, want = random.Random(3), [], []
    for group in ("a", "b", None):
        n = 300
        names = draw.sample(range(1000), n)
        ups = [[names[j] for j in draw.sample(range(i), min(i, draw.randrange(3)))] + [5000] for i in range(n)]
        source = {name: draw.randrange(40) for name in names}
        waits = {name: len(u) - 1 for name, u in zip(names, ups, strict=True)}
        ready, at = [(source[x], x) for x in names if not waits[x]], 0
        heapq.heapify(ready)
        while ready:
            x = heapq.heappop(ready)[1]
            want.append((str(group), x, at))
            at += 1
            for name, u in zip(names, ups, strict=True):
                if x in u:
                    waits[name] -= 1
                    if not waits[name]:
                        heapq.heappush(ready, (source[name], name))
        rows += [(group, name, source[name], u) for name, u in zip(names, ups, strict=True)]
    df = spark.createDataFrame(rows, "repo string, node int, source int, parents array<int>")
    got = graph.topological_order(df, "repo").collect()
    assert sorted((str(r["repo"]), r["node"], r["position"]) for r in got) == sorted(want)
    monkeypatch.setattr(graph, "_heap_order", None)
    line = spark.createDataFrame([(k, 7, [k - 1]) for k in range(50)], "node int, source int, parents array<int>")
    assert sorted(map(tuple, graph.topological_order(line).collect())) == [(k, k) for k in range(50)]


def test_tree_sizes_have_no_window_over_all_atoms(spark):
    from annalspark.operators import report

    ops = spark.createDataFrame([(k, k % 7, "Delete" if k % 5 == 0 else "Add") for k in range(1, 200)], "atom_idx long, path long, op string")
    sizes = report.tree_sizes(ops)
    live, want = set(), {}
    for k in range(1, 200):
        (live.discard if k % 5 == 0 else live.add)(k % 7)
        want[k] = len(live)
    assert {r["atom_idx"]: r["size"] for r in sizes.collect()} == want
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "[atom_idx" not in "".join(x for x in plan.splitlines() if "Window" in x and "_range" not in x)
