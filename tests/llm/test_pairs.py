"""Similarity operators against brute force on small, awkward tables."""

import re
from itertools import combinations

import numpy as np
import pytest

from annalspark.llm import components as cc
from annalspark.llm import jaccard, passages, vectors
from annalspark.llm.common import Stages

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(rng, n, vocabulary=4000):
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


def edited(rng, base, share):
    return [w if rng.random() > share else f"x{rng.integers(1 << 30)}" for w in base]


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    rows = [" ".join(words(rng, int(n))) for n in rng.integers(1, 300, 40)]
    for n in (5, 12, 40, 200, 600):
        base = words(rng, n)
        rows += [" ".join(edited(rng, base, share)) for share in np.linspace(0, 0.06, 12)]
        rows += [" ".join(base[: n - k]) for k in range(0, n // 5 + 1, max(1, n // 40))]
    passage = words(rng, 60)
    rows += [" ".join(words(rng, 80) + passage + words(rng, 70)) for _ in range(30)]
    rows += ["the " * 50, "the " * 60, "", None, " \t\n", "A b", "a B", "one", "one", "a b c d", rows[3].upper(), rows[3]]
    return rows


@pytest.mark.parametrize(("n", "percent", "small"), [(4, 85, {}), (5, 80, {"chunk": 16, "cell_sets": 6, "pivots": 3, "leaf": 4}), (2, 50, {"chunk": 8, "cell_sets": 4, "rounds": 1, "leaf": 4})])
def test_jaccard_components_are_exact(spark, texts, n, percent, small):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as `set`")
    got = {r["doc_id"]: r for r in jaccard.link(docs, jaccard.JaccardParams(words=n, percent=percent, **small)).collect()}
    sets = {i: shingles(t, n) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, links)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(links) > 20


def test_voronoi_cells_split_and_are_exact():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    common, sets = draw(400), []
    for _ in range(12):  # families that share much with each other, and members at all distances inside them
        own = np.concatenate([common[rng.random(400) < 0.8], draw(100)])
        sets += [np.unique(np.concatenate([own[rng.random(len(own)) > share], draw(int(share * 300))])) for share in rng.uniform(0, 0.12, 60)]
    p = jaccard.JaccardParams(leaf=64)
    cell, splits = jaccard.Cell(sets), []
    label = jaccard.voronoi(cell, np.ones(len(sets), bool), p, splits)
    links = []
    for a in range(len(sets)):
        rest = np.arange(a + 1, len(sets))
        links += [(a, int(b)) for b in rest[cell.linked(a, rest, cell.shared(a, rest), p)]]
    want = roots(range(len(sets)), links)
    assert len(splits) > 3 and len(set(want.values())) > 12
    assert [want[i] for i in range(len(sets))] == label.tolist()


def test_large_families_at_production_size(spark):
    rng = np.random.default_rng(9)
    base = words(rng, 120, 10**6)
    texts = []
    for _ in range(2600):  # edits at a few places each: pairs lie on both sides of the threshold
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            w[at] = f"y{rng.integers(1 << 40)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link(docs).collect()}
    hashed = [np.array(sorted(hash(g) & (2**63 - 1) for g in shingles(t, 4)), np.uint64) for t in texts]
    cell = jaccard.Cell(hashed)
    p, links = jaccard.JaccardParams(), []
    for a in range(len(texts)):
        rest = np.arange(a + 1, len(texts))
        links += [(a, int(b)) for b in rest[cell.linked(a, rest, cell.shared(a, rest), p)]]
    assert got == roots(range(len(texts)), links)


def test_keep_one(spark, texts):
    rows = [*enumerate(texts), (None, texts[0]), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'k' as set")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    sets = {i: shingles(t, 5) for i, t in enumerate(texts)}
    want = roots(sets, [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == {i for i, r in want.items() if i == r}
    assert ids.count(None) == 1
    assert jaccard.link(docs.limit(0)).count() == 0


def test_components_by_both_ways(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, int(x)) for x in rng.integers(2, 90, 50)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (90, 2)) if a != b] + [(5, 1), (1, 5)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    want = {n: r for n, r in roots({x for e in edges for x in e}, edges).items() if n != r}
    for bound in (10**6, 0):
        got = {r["node"]: r["component"] for r in cc.components(df, Stages(spark, "t"), f"c{bound}", bound).collect()}
        assert got == want


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [b.tolist() for b in rng.normal(size=(300, 16))]
    for b in base:
        rows += [(b + rng.normal(size=16) * s).tolist() for s in rng.uniform(0, 0.35, 12)]
    rows += [rows[0]] * 40 + [[2 * x for x in rows[1]], [0.0] * 16, None, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.1], [], [None] * 16, [1e300] * 16, [1e-300] * 16]
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)] + [(None, rows[0], 1), (None, None, 1)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.link(df, vectors.GraphParams(shard_points=120, shard_rows=30)).collect()}
    got.pop(None)
    links = []
    for dim in (2, 16):
        fine = [i for i, r in enumerate(rows) if r and len(r) == dim and None not in r and np.isfinite(r).all() and any(r)]
        v = vectors.unit(np.array([rows[i] for i in fine]))
        links += [(fine[a], fine[b]) for a, b in np.argwhere(np.triu(v @ v.T >= 0.9, 1))]
    truth = np.bincount(np.array(links).ravel(), minlength=len(rows))
    assert all(got[i]["n_links"] <= truth[i] for i in got)
    assert sum(got[i]["n_links"] for i in got) >= 0.97 * truth.sum() > 500
    want = roots(range(len(rows)), links)
    assert np.mean([got[i]["component_id"] == want[i] for i in got]) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert vectors.link(df.limit(0)).count() == 0


def test_vectors_recall_of_planted_links(spark):
    rng = np.random.default_rng(6)
    rows = []
    for b in rng.normal(size=(500, 32)):  # families of different points, with thousands of links between them
        rows += [(b + rng.normal(size=32) * s).tolist() for s in rng.uniform(0, 0.3, int(rng.integers(2, 14)))]
    rows += rng.normal(size=(2000, 32)).tolist()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    v = vectors.unit(np.array(rows))
    truth = (v @ v.T >= 0.9).sum(1) - 1
    for params in (vectors.GraphParams(shard_points=400), vectors.GraphParams(shard_points=3000, shard_rows=200, per_centroid=2000)):
        got = np.zeros(len(rows), int)
        for r in vectors.link(df, params).collect():
            got[r["vec_id"]] = r["n_links"]
        assert (got <= truth).all() and truth.sum() > 5000
        assert got.sum() >= 0.95 * truth.sum()
        audit = vectors.last_audit
        assert audit["links"] > 100 and audit["recall"] >= 0.95 and audit["with_links"] < audit["queries"]


def test_recall_without_links_is_unmeasured(spark):
    rows = [(i, [float(i == k) for k in range(12)]) for i in range(12)]
    got = vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), vectors.GraphParams())
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] for r in got.collect())
    assert vectors.last_audit["recall"] is None and vectors.last_audit["links"] == 0 and vectors.last_audit["queries"] == 12


def test_a_search_that_misses_fails(spark):
    rng = np.random.default_rng(7)
    rows = [(b + rng.normal(size=24) * 0.2).tolist() for b in rng.normal(size=(150, 24)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    blind = vectors.GraphParams(shard_points=10, probes=1, overlap=1, beam=1, rounds=1, nearest=1, degree=1, per_centroid=1)
    with pytest.raises(RuntimeError, match="recall"):
        vectors.link(df, blind)


def test_passages(spark):
    rng = np.random.default_rng(8)
    clean = [" ".join(words(rng, 200)) for _ in range(40)]
    planted = [words(rng, 55) for _ in range(6)]
    held = [" ".join(words(rng, int(rng.integers(0, 90))) + p + words(rng, int(rng.integers(0, 90)))) for p in planted for _ in range(4)]
    near = [" ".join(words(rng, 30) + edited(rng, p, 0.02) + words(rng, 30)) for p in planted for _ in range(2)]
    texts = [*clean, *held, *near, clean[0], "the " * 90, "the " * 90, "", None, "a b", "a b", "A  b\n", "a c", "one two three four five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "0 as removed")
    rows = passages.repeated(docs).collect()
    flagged = {r["doc_id"] for r in rows}
    hit = set(range(40, 64)) | {0, 76, 77, 78, 81, 82, 83}  # one word over and over and very short copies are copies too
    assert hit <= flagged and not flagged & (set(range(1, 40)) | {79, 80, 84, 85})
    assert len({r["doc_id"] for r in rows} & set(range(64, 76))) >= 10
    whole = [r for r in rows if r["doc_id"] == 76]
    assert whole[0]["removed"] and max(r["n_words"] for r in whole) > 150
    first = [r for r in rows if r["doc_id"] == 40]
    assert all(not r["removed"] for r in first)
    out = {r["doc_id"]: r for r in passages.remove(docs).collect()}
    assert len(out) == len(texts) and out[5]["text"] == texts[5] and out[81]["text"] == "a b" and not out[82]["text"].strip() and out[85]["text"] == texts[85] and len(out[76]["text"].split()) < 30
    assert out[76]["n_chars"] == len(out[76]["text"])
    assert passages.repeated(docs.limit(0)).count() == 0


def test_bands_meet_what_is_similar():
    rng = np.random.default_rng(12)
    p = passages.PassageParams()
    assert passages.band_recall(0.8, p) > 0.95
    met = total = 0
    for _ in range(1500):  # texts of one paragraph: one word replaced near an end leaves 9 to 11 of 13 shingles or so
        base = words(rng, 15, 10**6)
        other = list(base)
        other[int(rng.choice([0, 14]))] = "x"
        a, b = (passages.tv.Words(np.frombuffer((t := " ".join(w).encode()), np.uint8), np.array([0, len(t)], np.int64)) for w in (base, other))
        sets = [shingles(" ".join(w), 5) for w in (base, other)]
        if 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]):
            keys = [set(passages.band_keys(w, *passages.paragraphs(w, p)[:2], p)[0].tolist()) for w in (a, b)]
            total, met = total + 1, met + bool(keys[0] & keys[1])
    assert total > 1000 and met / total > 0.95


def test_linked_equals_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 12).astype(np.uint64)) for _ in range(60)]
    u, v = passages.linked(np.arange(60), sets, None, 30)
    pairs = [(a, b) for a, b in combinations(range(60), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 30 * len(np.union1d(sets[a], sets[b]))]
    assert roots(range(60), zip(u, v, strict=True)) == roots(range(60), pairs)
