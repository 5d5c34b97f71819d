"""Cross-tokenizer alignment against a plain version over byte offsets of whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from annalspark.llm import crosstok

LETTERS = "abcdeflmnorst"
ODD = ["", None, " ", "  a  b\t c\n\n d  ", "it's  we'll;\r\n x", "a\x1cb \x85d", "你好世界 \U0001f600 é", "<|endoftext|> <s> <unk> <0x0A>", "tail \n", "▁x ▁ y", "a▁b", "ﬁ é ²", "a\x00b", "x" * 500]


@pytest.fixture(scope="module")
def both():
    return crosstok.Pair(*crosstok.default_vocabularies())


def _tokens(both, text):
    """Ids of whole texts by the libraries, without cuts, and their bytes; nothing where they do not spell the text."""
    if not text:
        return [], []
    whole = (" " + text).encode()
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    if any(b"".join(spelled[i] for i in ids) != whole for spelled, ids in zip(both.spelled, (a, b), strict=True)):
        return [], []
    return a, b


def _plain(both, text):
    """Groups and links from the byte ranges of all tokens."""
    sides = []
    for ids, spelled in zip(_tokens(both, text), both.spelled, strict=True):
        at, spans = 0, []
        for i in ids:
            spans.append((at, at + len(spelled[i]), i))
            at += len(spelled[i])
        sides.append(spans)
    a, b = sides
    shared = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    groups = []
    for lo, hi in zip([0, *shared], shared, strict=False):
        groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in (a, b)))
    links = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]
    return len(a), len(b), ";".join(groups), links


def _expected(both, texts):
    plain = [_plain(both, t) for t in texts]
    held = Counter(p for _, _, _, links in plain for p in set(links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    rows = []
    for n_a, n_b, groups, links in plain:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        rows.append((n_a, n_b, len(groups.split(";")) if groups else 0, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest))
    return rows


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices(LETTERS + "é你", k=rng.randrange(1, 12))) for _ in range(60)]
    return [rng.choice([" ", "  ", ", ", "\n "]).join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(n)]


def test_transducer_on_small_vocabularies():
    a, b = [b"a", b"ab", b"c", b"abc"], [b"a", b"bc", b"b", b"cab", b"c"]
    made = crosstok.Transducer((a, b))
    linked = lambda *pairs: [x << 32 | y for x, y in pairs]
    assert made.align([1, 2], [0, 1]) == ([(2, 2)], linked((1, 0), (1, 1), (2, 1)))
    assert made.align([3, 3], [0, 2, 3, 4]) == ([(2, 4)], linked((3, 0), (3, 2), (3, 3), (3, 3), (3, 4)))
    assert made.align([0], [0]) == ([(1, 1)], linked((0, 0)))
    assert made.align([], []) == ([], [])
    assert made.align([0], []) is None and made.align([], [0]) is None and made.align([1], [0]) is None and made.align([1], [4]) is None


def test_transitions_are_remembered_and_can_be_forgotten(both, monkeypatch):
    made = crosstok.Transducer(both.spelled)
    a, b = _tokens(both, "some words again some words again")
    first = made.align(a, b)
    kept = made.kept
    assert made.align(a, b) == first and made.kept == kept
    monkeypatch.setattr(crosstok, "TRANSITIONS", 0)
    assert made.align(a, b) == first


def test_chunks_give_what_whole_texts_give(both):
    texts = [*ODD, *_texts(1, 80)]
    for text, held in zip(texts, both.align(texts), strict=True):
        n_a, n_b, groups, links = _plain(both, text)
        n = sum(h[0] for h in held)
        assert (n >> 80, n >> 40 & crosstok._FIELD, ";".join(h[1] for h in held)) == (n_a, n_b, groups)
        assert b"".join(h[2] for h in held) == b"".join((i << 32 | j).to_bytes(8, "little") for i, j in links)


def test_each_group_links_one_pair_less_than_it_has_tokens(both):
    for held in both.align(_texts(2, 30)):
        n = sum(h[0] for h in held)
        assert sum(len(h[2]) // 8 for h in held) == (n >> 80) + (n >> 40 & crosstok._FIELD) - (n & crosstok._FIELD)


@pytest.mark.parametrize("batch_bytes", [1, 300, 4_000_000])
def test_counted_equals_a_plain_version(spark, both, batch_bytes):
    texts = [*ODD, *_texts(3, 90), "same text here", "same text here"]
    rows = [(None if i == 20 else i // 2, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Batch int").withColumn("pairs", F.lit("x")).repartition(3)
    found = sorted(tuple(r) for r in crosstok.counted(docs, batch_bytes=batch_bytes).select(F.coalesce("doc_id", F.lit(-1)), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    wanted = sorted((-1 if r[0] is None else r[0], *e) for r, e in zip(rows, _expected(both, texts), strict=True))
    assert found == wanted


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.counted(docs).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert [tuple(r) for r in crosstok.counted(none).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, "", 0, 0) for i in (1, 2, 3)]
