import re

import numpy as np

from annalspark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECES = ["a.b@c.d", "@", "x@y", "1.2.3.4", "300.1.1.1", ".5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (605) 555-9305", " ", "word", "-", "1", "0", ".", "+", "é", "\n", "a@b@c.com", "(", ")"]


def plain(text):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_equals_the_patterns():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.integers(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_loopy_marginals_on_a_tree_are_exact():
    rng = np.random.default_rng(1)
    unary, pairs = rng.normal(size=(4, 5)), [(0, 1, 1.0), (1, 2, 2.0), (1, 3, 0.5)]
    joint = np.zeros((5,) * 4)
    for idx in np.ndindex(*joint.shape):
        joint[idx] = sum(unary[i, k] for i, k in enumerate(idx)) + sum(w for a, b, w in pairs if idx[a] == idx[b])
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    truth = np.array([joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)])
    assert np.allclose(pii.propagate(unary, pairs, 200), truth, atol=1e-3)


def test_skip_edges_carry_a_label():
    model = pii.CrfModel(pii.prior_weights(), skip=6.0)
    sure, unsure = "call +1 (605) 555-9305 now", "again (605) 555-9305 there"
    assert len(pii.find(unsure, model)[1]) == 0
    base, every = pii.find(f"{sure} and {unsure}, {unsure}", model)
    assert len(base) == 1 and [k for *_, k in every] == [3, 3, 3]


def test_edges_decide_after_training(spark):
    rng = np.random.default_rng(2)
    phone = lambda: f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    numbers = [phone() for _ in range(200)]
    # a mention without its country code has no base span; where the full one stands in the same text, however far, it is the same kind
    texts = [f"reach +1 {n} {'word ' * 40} then {n} later" for n in numbers[:120]] + [f"see {n} later" for n in numbers[120:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, Text string")
    model = pii.fit(docs, 150)
    assert model.emission.shape == (pii.N_FEATURES, 5) and model.skip > 1
    without = pii.CrfModel(model.emission, 0.0, 0.0)
    both, alone = ([sum(len(pii.find(t, m)[1]) - len(pii.find(t, m)[0]) for t in part) for part in (texts[:120], texts[120:])] for m in (model, without))
    assert both[0] >= 100 and both[1] == 0 and alone == [0, 0]
    assert pii.redact(docs, model).columns == ["doc_id", "Text"] and pii.redact(docs.limit(0)).count() == 0


def test_pseudo_likelihood_learns_its_edges():
    rng = np.random.default_rng(0)
    x = np.zeros((600, pii.N_FEATURES))
    x[:, 0] = 1
    y = np.repeat(rng.integers(0, 2, 300) * 4, 2)  # pairs with equal labels
    pairs = np.arange(600).reshape(-1, 2)
    far = np.stack([rng.permutation(600)[:300], rng.permutation(600)[:300]], 1)
    model = pii.train(x, y, far, pairs, 400)
    assert model.skip > 2 and abs(model.chain) < 0.7
    twisted = pii.train(x, np.tile([1, 4], 300), far, pairs, 400)
    assert twisted.skip < 2


def test_hidden_numbers_are_added_and_base_stays(spark):
    hidden = "ring +1 (605) 555-9305 4111111111111111 today"
    rows = [(i, f"mail u{i}@ex.org or +1 (7{i % 10}0) 555-1234, card 4111111111111111 ok 10.0.0.{i}") for i in range(60)] + [(100, hidden), (101, None), (102, ""), (None, "x 1.2.3.4"), (103, "clean text 12 34 of 2020")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as spans")
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert got[100]["n_phone"] == 0 and {s.split(":")[0] for s in got[100]["spans"].split(",")} == {"phone", "card"}
    assert got[101]["spans"] == got[102]["spans"] == got[103]["spans"] == "" and got[None]["n_ip"] == 1
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[100] == "ring [PHONE] [CARD] today" and masked[101] is None and masked[103] == rows[-1][1]
    assert pii.detect(docs.limit(0)).count() == 0


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" * 100_000, "a." * 150_000 + "@"):
        pii.find(text, pii.CrfModel(pii.prior_weights()))
