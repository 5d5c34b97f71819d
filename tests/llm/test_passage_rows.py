"""Removal of repeated passages where ids repeat or are missing."""

import time

import numpy as np
import pytest

from annalspark.llm import passages


def test_rows_with_repeated_and_null_ids_are_documents_of_their_own(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, 3), (2, words, 4), (2, "short text here", 5), (None, words + " and more", 6), (None, "other", 7), (3, None, 8), (3, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    out = {r["row"]: r for r in passages.remove(docs).collect()}
    assert len(out) == len(rows) and passages.remove(docs).columns == ["doc_id", "text", "row"]
    assert out[3]["text"] == words and "word5 " not in out[4]["text"] and out[5]["text"] == "short text here"
    assert "word5 " not in out[6]["text"] and out[7]["text"] == "other" and out[8]["text"] is None and out[9]["text"] == ""
    assert [out[k]["doc_id"] for k in range(3, 10)] == [1, 2, 2, None, None, 3, 3]


def _sets(rng, n, vocabulary, near):
    base = [rng.choice(vocabulary, rng.integers(1, 13), replace=False) for _ in range(max(1, n // near))]
    out = []
    for _ in range(n):
        one = base[rng.integers(len(base))].copy()
        for _ in range(rng.integers(0, 3)):
            one[rng.integers(len(one))] = rng.integers(vocabulary, 2 * vocabulary)
        out.append(np.unique(one).astype(np.uint64))
    return out


def _labels(n, edges):
    label = list(range(n))
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_links_are_those_of_all_pairs(percent):
    rng = np.random.default_rng(percent)
    for t in range(60):
        n = int(rng.integers(1, 60))
        sets, across = _sets(rng, n, (13, 40, 4000)[t % 3], (1, 5, 50)[t // 3 % 3]), None if t % 2 else rng.integers(0, 2, n)
        u, v = passages.linked(np.arange(n), sets, across, percent)
        pairs = [(i, j) for i in range(n) for j in range(i) if across is None or across[i] != across[j]]
        similar = {(i, j) for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert {(max(p), min(p)) for p in zip(u.tolist(), v.tolist())} <= similar
        assert _labels(n, similar) == _labels(n, zip(u.tolist(), v.tolist()))


def test_contents_that_share_only_common_shingles_are_not_compared():
    """8,192 contents that all hold the same six shingles, and six of their own: nothing is similar, and none is looked for in all."""
    rng = np.random.default_rng(3)
    sets = [np.unique(np.append(np.arange(6, dtype=np.uint64), rng.integers(6, 1 << 60, 6, dtype=np.uint64))) for _ in range(8192)]
    began = time.process_time()
    u, _ = passages.linked(np.arange(8192), sets, np.arange(8192) % 2, 80)
    assert not len(u) and time.process_time() - began < 5
