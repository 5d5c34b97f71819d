"""Byte-level BPE and fill-in-the-middle against the public library and plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalspark.llm import bytebpe, chunks, infilling

LETTERS = "abcdeflmnorst"
ODD = [
    "",
    " ",
    "  a  b\t c\n\n d  ",
    "it's  we'll x   y",
    "a\x1cb \x1f c\x85d",
    "你好世界 \U0001f600\U0001f600 é",
    "<|endoftext|> 123 4,567.89",
    "tail \n",
    "\x00\x00 a\x00",
    "▁x ▁",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ranks_of(bytebpe.default_vocabulary()), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return bytebpe.Codec(bytebpe.default_vocabulary(), public_tokenizers.PATTERN)


def _ids(data):
    return np.frombuffer(data, "<i4").tolist()


def test_ids_equal_the_library(codec, library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices(LETTERS + " .,'\n0123", k=rng.randrange(1, 400))) for _ in range(60)]
    assert [_ids(f) for f in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library_and_comes_back(codec, library, text):
    (found,) = codec.encode([text])
    assert _ids(found) == library.encode_ordinary(text)
    assert codec.decode([np.frombuffer(found, "<i4")]) == [text.encode()]


def test_long_words_contract_many_pairs_a_round(codec, library):
    rng = random.Random(2)
    words = ["a" * 3000, "ab" * 700, "=" * 500, " " * 900, "etaoin" * 100, "".join(rng.choices("etaoinshr", k=2500)), "".join(map(chr, rng.choices(range(0x4E00, 0x4F00), k=600)))]
    words += ["".join(rng.choices("abcde", k=n)) for n in range(60, 80)]
    assert [_ids(f) for f in codec.encode(words)] == [library.encode_ordinary(w) for w in words]


def test_both_contractions_agree_on_every_length(codec):
    rng = random.Random(3)
    words = list({"".join(rng.choices("ethrnais", k=n)).encode() for n in range(2, 90) for _ in range(4)})
    assert codec._contract(words, bytebpe._SHORT) == codec._contract(words, bytebpe._LONG.format(rounds=5))


def test_a_word_in_the_vocabulary_is_one_token(codec, library):
    rng = random.Random(4)
    tokens = [b.decode() for b in rng.sample(sorted(codec.ranks), 3000) if b.isascii()]
    assert [_ids(f) for f in codec.encode(tokens)] == [library.encode_ordinary(t) for t in tokens]


def test_forgetting_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(codec.words, "cached", 20)
    monkeypatch.setattr(bytebpe, "IDS_TOGETHER", 10)
    texts = [f"word{i} other{i % 7}, \n {i}" for i in range(100)]
    for lo in range(0, 100, 10):
        found = codec.encode(texts[lo : lo + 10])
        assert [_ids(f) for f in found] == [library.encode_ordinary(t) for t in texts[lo : lo + 10]]
        assert codec.decode([np.frombuffer(f, "<i4") for f in found]) == [t.encode() for t in texts[lo : lo + 10]]


def test_decoding_of_ids_that_no_text_gives(codec):
    space = next(r for b, r in codec.ranks.items() if b == b" ")
    half = codec.ranks[b"\xe4"]
    assert codec.decode([np.array([space, space, half]), np.array([], np.int64), None, np.array([10**6]), np.array([-1])]) == [b"  \xe4", b"", None, None, None]


def test_chunks_join_to_the_text():
    cut = chunks.Chunks(list)
    for text in [*ODD, "a b", " a b", "a b ", "a  b c", "a\n b", "a \nb c d"]:
        (found,) = cut.values([text])
        assert "".join(found) == " " + text
    assert chunks.Chunks(list).values(["one two\nthree four"]) == [[" one", " two\nthree", " four"]]


def test_keys_in_use_come_back_from_the_old_generation():
    learned = []
    kept = chunks.Remembered(lambda new: learned.extend(new) or [k.upper() for k in new], 3)
    assert kept.of([["a", "b"], ["c"]])["b"] == "B"
    assert kept.of([["a"], ["d"]]) == {"a": "A", "d": "D"}
    assert kept.of([["b"]])["b"] == "B" and learned.count("b") == 1
    assert kept.of([["e"]]) == {"e": "E"}
    assert kept.of([["b"], ["x", "y", "z"]])["b"] == "B" and len(learned) == 9


def test_byte_bpe_rows(spark, library):
    rows = [(1, "Hello  world", 7), (1, "Hello  world", 8), (None, "x", 9), (2, None, 9), (3, "", 9), (4, "long " * 5000 + "y" * 2000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("decoded", F.lit(1))
    found = bytebpe.digests(docs).collect()
    assert len(found) == 6
    for (doc_id, text, _), row in zip(rows, found, strict=True):
        ids = library.encode_ordinary(text or "")
        assert row.doc_id == doc_id and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bytebpe.digests(docs.limit(0)).count() == 0
    lists = spark.createDataFrame([(1, [0, None]), (2, None), (3, []), (4, [10**7])], "doc_id int, ids array<int>")
    assert [r.decoded for r in bytebpe.decode(lists).orderBy("doc_id").collect()] == [None, None, b"", None]


def _plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    key = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_a_plain_version(spark):
    rng = random.Random(5)
    texts = [*ODD, None, "<P>", "a <S b> c", "<<P", "x<M> y", "<S><", "< <P < S> <M", "one", "\t\r\n", "\U0001f600 \U0001f601 z " * 400]
    texts += ["".join(rng.choices("ab<PSM> \né\U0001f600", k=rng.randrange(1, 80))) for _ in range(300)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(7, "again  and again", 0), (7, "again  and again", 0), (None, "no id at all", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Output int").withColumn("FORM", F.lit("x"))
    found = infilling.digests(docs).collect()
    assert len(found) == len(rows)
    seen = set()
    for (doc_id, text, _), row in zip(rows, found, strict=True):
        n, form, prefix, middle, output = _plain_fim(doc_id, text)
        assert (row.doc_id, row.n, row.form, row.prefix_chars, row.middle_chars) == (doc_id, n, form, prefix, middle)
        assert row.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert row.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        seen.add(form)
    assert seen == {"plain", "spm", "psm"}
    assert infilling.digests(docs.limit(0)).count() == 0


def test_marks_that_touch_pieces_are_found_again(spark):
    pieces = ["", "<", "<<", ">", "P>", "S>", "M>", "<S", "<P", "<M", "a < b"]
    rows = [(f, p, m, s) for f in ("psm", "spm") for p in pieces for m in pieces for s in pieces if not any(x in p + m + s for x in ("<P>", "<S>", "<M>"))]
    made = [(f, p + m + s, f"<P>{p}<S>{s}<M>{m}" if f == "psm" else f"<S>{s}<P>{p}<M>{m}") for f, p, m, s in rows]
    df = spark.createDataFrame(made, "form string, text string, output string")
    assert df.filter(infilling.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0


def test_all_documents_change_at_full_rate(spark):
    docs = spark.createDataFrame([(i, f"some words of number {i}") for i in range(50)], "doc_id int, text string")
    found = infilling.transform(docs, rate=100, spm_rate=0).collect()
    assert {r.form for r in found} == {"psm"}
    assert all(r.prefix + r.middle + r.suffix == f"some words of number {r.doc_id}" for r in found)
