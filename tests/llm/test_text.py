"""Word hashing and token ids against plain Python and the tokenizer library."""

import re

import numpy as np
import pyarrow as pa
import pytest

from annalspark.llm import textvec as tv
from annalspark.llm import tokens

TEXTS = ["", None, "A b  c d e", "x", "É À a\tb\x0bC \n", "abcdefghijklmnopqrstuvwxyz a " * 3, " ", "A B", "a b", "w" * 9000 + " z", "don't 'set it's  x\x1cy a\x1fb 日本 <|endoftext|> ΑΣ İx 12a"]
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_words_and_shingles():
    for limit in (1, 50, 1 << 20):
        at = 0
        for a, b, words in tv.each(pa.array(TEXTS), limit):
            assert a == at
            at = b
            for i, text in enumerate(TEXTS[a:b]):
                plain = WORD.findall(lower(text))
                own = words.h[words.off[i] : words.off[i + 1]]
                assert len(own) == len(plain)
                assert [tv.hash_words(w)[0] for w in plain] == list(own)
            g, off = words.grams(4, whole=True)
            for i, text in enumerate(TEXTS[a:b]):
                n = len(WORD.findall(text or ""))
                assert off[i + 1] - off[i] == (n - 3 if n >= 4 else int(n > 0))
        assert at == len(TEXTS)


def test_members():
    values = np.arange(0, 5000, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, which = tv.Members(values).find(np.concatenate([values[:10], values[:10] + np.uint64(1)]))
    assert list(at) == list(range(10))
    assert np.array_equal(tv.Members(values).values[which], values[:10])


def test_ids_equal_the_library():
    pytest.importorskip("public_tokenizers")
    encoder = tokens.encoder(tokens.default_vocabulary())
    for text, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.whole.encode(text or "", add_special_tokens=False).ids


def test_an_encoder_keeps_words_in_use_when_it_is_full():
    """Rare words push out rare ones: a word that every text holds is looked up in the merge model once."""
    encoder, looked_up = tokens.Encoder(tokens.default_vocabulary(), cached=100), []

    class Model:
        def __init__(self, model):
            self.model = model

        def tokenize(self, word):
            looked_up.append(word)
            return self.model.tokenize(word)

    common = ["w" * (i + 2) for i in range(20)]
    rare = lambda k: [chr(97 + k // 26) + chr(97 + k % 26) + "q" + chr(97 + i) * 2 for i in range(26)]
    texts = [" ".join([*common, *rare(k), "Q" * 300, "ΑΣ", "J̌'S"]) for k in range(60)]
    encoder.model = Model(encoder.model)
    found = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [encoder.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(looked_up.count(w) == 1 for w in common)
    assert max(map(len, encoder.pieces)) <= tokens.LONG and len(encoder.pieces) + len(encoder.pieces.old) <= 200
