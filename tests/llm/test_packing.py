import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalspark.llm import packing

pytest.importorskip("public_tokenizers")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 99), max_size=80))
def test_bins_hold_all_and_search_never_adds(sizes):
    lengths = np.array(sizes, np.int64)
    bins = packing.best_fit(lengths, 100)
    better = packing.improve([list(b) for b in bins], lengths, 100)
    assert sorted(i for b in better for i in b) == list(range(len(sizes)))
    assert all(lengths[b].sum() <= 100 for b in better)
    assert -(-int(lengths.sum()) // 100) <= len(better) <= len(bins)


def test_exchange_empties_a_bin():
    # best fit decreasing needs four bins here, three are enough
    lengths = np.array([6, 5, 5, 4, 4, 3, 3], np.int64)
    bins = [[0, 5], [1, 3], [2, 4], [6]]
    assert len(packing.improve(bins, lengths, 10)) == 3


def test_pack(spark):
    rows = [(1, "a b c"), (2, None), (3, "word " * 5000), (3, "word " * 5000), (None, ""), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as piece", "'z' as sequence_id")
    out = packing.pack(docs).toPandas()
    assert len(out) == 4 + 2 * 3
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]]
        assert seq["length"].sum() <= 2048
    assert sorted(out[out.doc_id == 3]["length"]) == [905, 905, 2048, 2048, 2048, 2048]
    assert packing.pack(docs.limit(0)).count() == 0


def test_pieces_equal_a_plain_tokenizer(spark):
    import zlib

    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(path("word_bpe_49k.json")))
    rng = np.random.default_rng(3)
    signs = list("abcdeéß漢\U0001f600 ,.;:!?'\"()0123456789\n\t") + ["the ", "water ", "don't ", "ÉTÉ ", "  ", "http://x.y/z "]
    texts = ["".join(rng.choice(signs, int(n))) for n in rng.integers(0, 400, 60)] + ["", None, " ", "\n\n", "word " * 3000, "x" * 9000, "é" * 3000]
    rows = [*enumerate(texts), (None, "a null id"), (4, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for doc_id, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want.append((-1 if doc_id is None else doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    got = packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)


def test_equal_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(None, None)] * 3000, "doc_id long, text string")
    out = packing.pack(docs, group_rows=500).toPandas()
    assert len(out) == 3000 and (out["sequence_id"] // 2**40).nunique() == 6
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
