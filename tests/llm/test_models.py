"""Quality, language model, decontamination, URL and token-file operators against plain versions."""

import collections
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from annalspark.llm import decontaminate, lm, quality, tokenfiles, urls

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def low(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), vocabulary))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    return [prose(rng, int(n)) for n in rng.integers(0, 200, 300)]


# --- language model ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_lm_counts_and_scores(spark, corpus, small):
    rows = [*enumerate(corpus), (900, None), (901, ""), (902, "Never SEEN before Ünïcode"), (None, "w1 w2"), (5, corpus[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score").repartition(3)
    p = lm.LmParams(batch_bytes=4000, part_bytes=6000, min_context=4) if small else lm.LmParams(min_context=4)
    got = lm.score(docs, p).collect()
    assert len(got) == len(rows)
    uni, ctx, pair = collections.Counter(), collections.Counter(), collections.Counter()
    for i, text in rows:
        if lm.fold_of(i) % 5 != 1:
            tokens = ["<s>", *low(text), "</s>"]
            uni.update(tokens[1:])
            ctx.update(tokens[:-1])
            ctx["</s>"] += 1
            pair.update(zip(tokens, tokens[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    text_of = dict(rows)
    for r in got:
        tokens = [*low(text_of[r["doc_id"]]), "</s>"]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(tokens), n, sum(uni[t] > 0 for t in tokens))
        assert r["held_out"] == (lm.fold_of(r["doc_id"]) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), abs=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 1]
    assert sum(r["score"] for r in held) > 1.01 * sum(r["base_score"] for r in held)  # words are independent here


def test_lm_probabilities_sum_to_one(spark):
    # one held-out document per word after the same context: their probabilities and that of an unknown word
    rng = np.random.default_rng(3)
    train = [(i, " ".join(rng.choice(["a", "b", "c", "d"], 30))) for i in range(400)]
    ids = [i for i in range(1000, 3000) if lm.fold_of(i) % 5 == 1][:6]
    probes = list(zip(ids, ["a", "b", "c", "d", "zzz", ""], strict=True))
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(train + probes, "doc_id long, text string")).collect()}
    end = {w: got[i]["score"] for i, w in probes}
    # P(w | start) = P(w, end) / P(end | w); the end's probability after a frequent word comes from its own counts
    assert sum(10 ** end[w] for w in ("a", "b", "c", "d", "zzz", "")) < 1
    assert got[ids[0]]["train_tokens"] == sum(31 for i, _ in train if lm.fold_of(i) % 5 != 1)


@pytest.mark.parametrize("small", [False, True])
def test_lm_equals_a_plain_model(spark, small):
    rng = np.random.default_rng(12)
    rows = []
    for i, n in enumerate(rng.integers(0, 80, 400)):
        words = prose(rng, int(n), 3000).split()
        rows.append((i, " ".join(x for w in words for x in ([w, f"{w}s"] if rng.random() < 0.7 else [w]))))
    p = lm.LmParams(batch_bytes=4000, part_bytes=6000) if small else lm.LmParams()
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), p).collect()}
    fit, em = ([collections.Counter() for _ in range(2)] for _ in range(2))  # words and contexts, pairs
    for i, text in rows:
        crc = lm.fold_of(i)
        if crc % 5 != 1:
            tokens = ["<s>", *low(text), "</s>"]
            one, two = fit if crc // 5 % 5 else em
            one.update(tokens)
            two.update(zip(tokens, tokens[1:], strict=False))
    level = lambda n: min(1 + math.floor(4 * math.log2(n)), 254) if n else 0
    cells = collections.Counter()
    for (u, w), n in em[1].items():
        cells[level(fit[0][u]) << 16 | level(fit[1][u, w]) << 8 | level(fit[0][w])] += n
    one, two = fit[0] + em[0], fit[1] + em[1]
    total, types = sum(n for w, n in one.items() if w != "<s>"), len(one) - 1
    weights = lm.learn(sorted(cells.items()), total * (1 - 1 / 5), types, p)
    assert (weights[1:5, 0] > 0.001).all()  # 1, 2-3, 4-7 and 8-15
    for i, text in rows:
        tokens, log = ["<s>", *low(text), "</s>"], 0.0
        for u, w in zip(tokens, tokens[1:], strict=False):
            a, b, c = weights[1 + int(math.log2(one[u]))] if one[u] else weights[0]
            log += math.log10(a * two[u, w] / max(one[u], 1) + b * one[w] / total + c / (types + 1))
        assert got[i] == pytest.approx(log, abs=1e-6)


def test_em_finds_the_mixture():
    p = lm.LmParams()
    rng = np.random.default_rng(0)
    # a context of level 41 (count about 1,100): tokens come from the pair estimate in 7 of 10 cases
    pair_level, word_level = 33, 21
    cells = [((41 << 16) | (pair_level << 8) | word_level, 70_000), ((41 << 16) | word_level, 25_000), (41 << 16, 5_000)]
    w = lm.learn(cells, 100_000, 1000, p)
    bucket = int(lm._bucket(np.array([2 ** ((41 - 1 + 0.5) / 4)]), p)[0])
    assert w[bucket].sum() == pytest.approx(1) and w[bucket, 0] > 0.5 and (w[bucket] > 0).all()
    assert rng is not None and lm.learn([], 1, 1, p)[0, 0] == 0


def test_packed_integers():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert np.array_equal(lm.unsqueeze_sorted(lm.squeeze_sorted(keys)), keys)
        assert np.array_equal(lm.unsqueeze(lm.squeeze(keys.astype(np.int64)), np.int64), keys.astype(np.int64))


# --- quality ------------------------------------------------------------------------------------------------------------


def test_quality_catches_and_keeps(spark, corpus):
    rng = np.random.default_rng(6)
    bad = [" ".join(w if rng.random() > 0.1 else rng.choice(["idiotic", "vile", "scummy"]) for w in prose(rng, 120).split()) for _ in range(120)]
    good = [t for t in corpus if len(t) > 200]
    texts = [*good, *bad]
    docs = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, ""), (None, "w1")], "doc_id long, text string").selectExpr("*", "1 as log_weight", "2 as noise")
    labels = spark.createDataFrame([(i, 1, int(i >= len(good))) for i in range(0, len(texts), 2)] + [(None, 1, 1), (5, None, None), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows, _, _ = quality.select(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in rows.collect()}
    assert np.mean([kept[i] for i in range(len(good))]) > 0.97
    assert np.mean([kept[i] for i in range(len(good), len(texts))]) < 0.1
    out = quality.resample(docs, labels)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, k in kept.items() if k}
    assert quality.resample(docs, labels.limit(0)).count() == docs.count()
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_gumbel_top_k(spark):
    from annalspark.llm.common import kth_largest

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for k in (0, 1, 77, 500, 900):
        assert sum(r["kept"] for r in quality.select(docs, empty, k)[0].collect()) == min(k, 500)
    values = np.random.default_rng(1).normal(size=3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in (1, 2, 500, 2999, 3000):
        assert kth_largest(df, "x", k, 16) == np.sort(values)[-k]


def test_draws_follow_the_weights(spark):
    from annalspark.llm.textvec import mix

    # Gumbel top-k draws without replacement in proportion to the weights: the first draw follows them
    keys = mix(np.arange(1, 40_001).astype(np.uint64)).view(np.int64)
    noise = quality._gumbel(keys).reshape(-1, 4)
    weight = np.array([0.1, 0.2, 0.3, 0.4])
    first = (np.log(weight) + noise).argmax(1)
    assert np.allclose(np.bincount(first) / len(first), weight, atol=0.02)


def test_word_pairs_alone_reject(spark):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(30)]
    good = [" ".join(rng.choice(words, 40)) for _ in range(150)]
    bad = [" ".join(t.split()[:30]) + " v1 v2 v3 v4" * 3 for t in good[:50]]  # ordinary words, in an order of their own
    good = [t.replace("v1 v2", "v1").replace("v3 v4", "v3").replace("v2 v3", "v2") for t in good]
    docs = spark.createDataFrame(list(enumerate([*good, *bad])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 150)) for i in range(200)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.select(docs, labels)[0].collect()}
    assert np.mean([kept[i] for i in range(150)]) > 0.95 and np.mean([kept[i] for i in range(150, 200)]) < 0.2


def test_weights_equal_a_plain_version(spark):
    texts = ["good words here", "good words there", "bad bad words", "bad things", "good bad"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    p = quality.QualityParams(prior=0.1, pair_prior=0.3, dead_zone=0.05)
    got = {r["doc_id"]: r["log_weight"] for r in quality.select(docs, labels, 5, p)[0].collect()}
    feats = []
    for t in texts:
        w = t.split()
        feats.append({("w", x) for x in w} | {("2", x[-2:]) for x in w} | {("3", x[-3:]) for x in w} | {("pair", *x) for x in zip(w, w[1:], strict=False)})
    raw, target = collections.Counter(f for fs in feats for f in fs), collections.Counter(f for fs in feats[:2] for f in fs)
    for i, fs in enumerate(feats):
        prior = {f: 0.3 if f[0] == "pair" else 0.1 for f in fs}
        ratios = [math.log((target[f] - (i < 2) + prior[f]) / ((raw[f] - 1) * 2 / 5 + prior[f])) for f in fs]
        assert got[i] == pytest.approx(sum(r for r in ratios if r < -0.05), abs=1e-5)


# --- decontamination ------------------------------------------------------------------------------------------------------


def plain_alignment(doc, item, p):
    best = 0
    s = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            s[i][j] = max(0, s[i - 1][j - 1] + (p.match if item[i - 1] == doc[j - 1] else p.mismatch), s[i - 1][j] + p.gap, s[i][j - 1] + p.gap)
            best = max(best, s[i][j])
    return best


def test_alignment_is_smith_waterman():
    rng, p = np.random.default_rng(9), decontaminate.SeedParams()
    for _ in range(200):
        doc, item = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 20))
        score, equal, start, end = decontaminate.smith_waterman(doc, item, p)
        assert score == plain_alignment(doc.tolist(), item.tolist(), p)
        assert equal <= min(len(item), end - start)


@pytest.mark.parametrize("block", [200_000, 60])
def test_contaminated(spark, corpus, block):
    rng = np.random.default_rng(4)
    items = [" ".join(f"q{int(x)}" for x in rng.integers(0, 2000, n)) for n in (16, 25, 40, 60, 2)]
    edit = lambda t, k: " ".join(w if i % k else "changed" for i, w in enumerate(t.split(), 1))
    dirty = [f"{corpus[1]} {t} {corpus[2]}" for t in items[:4]] + [f"{corpus[3]} {edit(t, 6)} {corpus[4]}" for t in items[:4]] + [items[2].upper()]
    rows = [*enumerate([*corpus[:100], *dirty]), (None, None), (500, ""), (501, items[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as item_id")
    bench = spark.createDataFrame([*enumerate(items), (10, None), (11, "")], "item_id long, text string")
    p = decontaminate.SeedParams(block_grams=block)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench, p).collect()}
    assert set(got) == {(100 + i, i % 4) for i in range(8)} | {(108, 2), (501, 0)}
    assert all(got[100 + i, i]["score"] == 1 for i in range(4)) and got[104, 0]["score"] < 1
    left = decontaminate.clean(docs, bench, p)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [*range(100), 500]
    assert decontaminate.contaminated(docs, bench.limit(0), p).count() == 0 and decontaminate.clean(docs.limit(0), bench, p).count() == 0


def test_contaminated_equals_all_pairs(spark):
    rng = np.random.default_rng(21)
    p = decontaminate.SeedParams()
    draw = lambda n: [f"v{int(x)}" for x in rng.integers(0, 60, n)]  # noqa: E731  few words, so that chance matches abound
    items = [draw(int(n)) for n in (3, 8, 12, 20, 20, 35, 60)]
    docs = [draw(int(n)) for n in rng.integers(1, 120, 40)]
    for item in items:
        docs += [draw(20) + [w if i % 3 else "other" for i, w in enumerate(item, 1)] + draw(20), [w for x in item for w in (x, "put")][:-1]]
        for share in (0.0, 0.1, 0.2, 0.3, 0.45):
            held = [w for x in item for w in ([x] if rng.random() > share else [[], ["new"], [x, "more"]][rng.integers(3)])]
            docs.append(draw(20) + held + draw(20))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"), p).collect()}
    want = {}
    for k, item in enumerate(items):
        hashed = decontaminate.tv.hash_words(" ".join(item))
        for i, doc in enumerate(docs):
            score, equal, _, _ = decontaminate.smith_waterman(decontaminate.tv.hash_words(" ".join(doc)), hashed, p)
            if score >= p.threshold * p.match * len(item) and equal >= min(p.min_words, len(item)):
                want[i, k] = round(score / (p.match * len(item)), 6)
    assert got == pytest.approx(want) and len(want) >= 40


def test_rarest_seeds_meet_every_alignment_that_passes():
    rng, p = np.random.default_rng(12), decontaminate.SeedParams()
    passed = 0
    for trial in range(600):
        item = [f"v{int(x)}" for x in rng.integers(0, 40, rng.integers(1, 30))]
        block = next(decontaminate.blocks([(0, " ".join(item))], p))
        rare = decontaminate.rarest(block, rng.integers(0, 50, len(block.members.values)))
        assert len(rare.gram) <= len(block.gram) and (len(item) < 12 or len(set(rare.gram)) < 0.8 * len(block.gram))
        share = rng.random() * 0.6
        held = [w for x in item for w in ([x] if rng.random() > share else [[], ["new"], [x, "more"]][rng.integers(3)])]
        doc = decontaminate.tv.hash_words(" ".join(["pre"] * int(rng.integers(0, 5)) + held + ["post"]))
        hits = [decontaminate.grams(doc, s) for s in rare.steps]
        at = np.unique(np.concatenate([rare.members.find(h)[0] for h in hits]))
        score, equal, _, _ = decontaminate.smith_waterman(doc, block.items[0].words, p)
        passes = score >= p.threshold * p.match * len(item) and equal >= min(p.min_words, len(item))
        passed += passes
        found = decontaminate.align(doc, {0: at}, rare, p)
        assert bool(found) == passes and (not passes or found[0][1:3] == (score / (p.match * len(item)), equal))
    assert passed >= 200


def test_items_that_leaked_often_are_found(spark, corpus):
    rng = np.random.default_rng(8)
    items = [" ".join(f"q{int(x)}" for x in rng.integers(0, 2000, n)) for n in (30, 30)]
    edited = " ".join(w if i % 6 else "changed" for i, w in enumerate(items[0].split(), 1))
    dirty = {i: items[0] if i % 2 else edited for i in range(0, 300, 3)} | {1: f"{items[1]} {items[0]}"}
    docs = spark.createDataFrame([(i, f"{corpus[i]} {dirty.get(i, '')} {corpus[i - 1]}") for i in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(i, 0) for i in dirty} | {(1, 1)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(300)) - set(dirty)


def test_long_stretches_are_aligned_in_pieces():
    rng, p = np.random.default_rng(10), decontaminate.SeedParams()
    item = " ".join(f"q{int(x)}" for x in rng.integers(0, 2000, 40))
    block = next(decontaminate.blocks([(0, item)], p))
    words, common = item.split(), item.split()[:3]
    for at in (*range(3900, 4200, 20), 11_000):
        text = (common + ["x"] * 9) * 1000
        text[at : at + 40] = words
        doc = decontaminate.tv.hash_words(" ".join(text))
        seeds, _ = block.members.find(decontaminate.grams(doc, 1))
        assert decontaminate.align(doc, {0: seeds}, block, p) == [(0, 1, 40, at, at + 40)]


# --- URLs -----------------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    cases = [
        ("http://A.Example.ORG/x?y#z", "a.example.org", "/x", "org/", "allow"),
        ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        ("https://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1", "block"),
        ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("x://org", "org", "", None, None), ("x://org?/a", "org", "", None, None), ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"),
        ("a://b://c/d", "b:", "//c/d", None, None), (None, "", "", None, None), ("no scheme/x", "", "", None, None), ("ÄB://ÄB.com/fr/É", "Äb.com", "/fr/É", "com/fr/", "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)] + [(None, "http://q/", "")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or "allow")
    assert urls.judge(pages.limit(0)).count() == 0


def test_bad_templates_are_rejected(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(400)] + [(1000 + i, f"http://k.net/u/name{i}x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([(i, bool(i % 2)) for i in range(0, 400, 3)] + [(None, True)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urls.judge(pages, labelled).collect()}
    assert all(got[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(400))
    assert {got[i]["template"] for i in range(400)} == {"/spam/*.html//", "/news/*.html//"}
    assert len({got[1000 + i]["template"] for i in range(60)}) == 1


def test_similar_siblings_merge_and_deep_paths_count(spark):
    bad_in = {"s1": 0.95, "s2": 0.9, "n1": 0.05, "n2": 0.1, "n3": 0.0}
    rng = np.random.default_rng(4)
    rows, labelled = [], []
    for k, (seg, share) in enumerate(bad_in.items()):
        for i in range(60):
            rows += [(1000 * k + i, f"http://h.net/{seg.replace('1', 'a').replace('2', 'b').replace('3', 'c')}/{i}"), (50_000 + 1000 * k + i, f"http://deep.net/a/b/c/{seg.replace('1', 'x').replace('2', 'y').replace('3', 'z')}/{i}")]
            labelled += [(n, bool(rng.random() < share)) for n in (1000 * k + i, 50_000 + 1000 * k + i)]
    rows += [(90_000 + i, f"http://hex.net/x/{rng.integers(1 << 60):015x}1.html") for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, spark.createDataFrame(labelled, "page_id long, bad boolean")).collect()}
    for at, low, high in ((0, "/*/*//", "/*!/*//"), (50_000, "/a/b/c/*", "/a/b/c/*!")):
        for k, seg in enumerate(bad_in):
            r = got[at + 1000 * k + 7]
            assert (r["template"], r["verdict"]) == ((high, "block") if seg[0] == "s" else (low, "allow"))
    assert {got[90_000 + i]["template"] for i in range(10)} == {"/x/*.html//"}


# --- token files ------------------------------------------------------------------------------------------------------------


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        slots = tokenfiles.permute(np.arange(n), n, 99)
        assert sorted(slots) == list(range(n))
        assert all(tokenfiles.feistel(i, n, 99) == s for i, s in enumerate(slots))
    assert not np.array_equal(tokenfiles.permute(np.arange(1000), 1000, 1), tokenfiles.permute(np.arange(1000), 1000, 2))


def test_shards_round_trip(spark, corpus, tmp_path):
    pytest.importorskip("public_tokenizers")
    from annalspark.llm import tokens

    rows = [*enumerate(corpus), (None, "x y z"), (901, None), (902, "w1 " * 3000), (5, corpus[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as slot").repartition(3)
    p = tokenfiles.ShardParams(length=64, per_shard=50)
    manifest = tokenfiles.materialise(docs, f"file://{tmp_path}/out", params=p).collect()
    files = sorted(Path(tmp_path, "out").glob("part-*"))
    n = len(manifest)
    assert len(files) == -(-n // 50) and sorted(r["slot"] for r in manifest) == list(range(n))
    stride, total = 64 * 2 + 1, collections.Counter()
    for r in manifest:
        with open(files[r["shard"]], "rb") as f:
            f.seek(r["byte_offset"])
            record = f.read(stride)
        ids = np.frombuffer(record[:-1], "<u2").astype("<u4")
        assert record[-1:] == b"\n" and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and not ids[r["n_tokens"] :].any()
        total.update(ids[: r["n_tokens"]].tolist())
    encode = tokens.encoder(tokens.default_vocabulary()).encode
    want = collections.Counter()
    for _, text in rows:
        want.update([*np.frombuffer(encode([text])[0], "<u4").tolist(), 0])
    assert total == want
    assert tokenfiles.materialise(docs.limit(0), params=p).count() == 0
