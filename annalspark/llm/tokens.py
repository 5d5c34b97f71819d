"""Token ids of texts by a public word-level BPE vocabulary, with a bounded cache of white-space-separated pieces.

The vocabulary's rules (canonical composition, lower case, white space dropped, a pattern that cuts words, digits and
runs of other signs apart) never join characters across white space, so the ids of a text are the ids of its pieces one
after another.  A piece is cut by the vocabulary's own pattern and each part is looked up in the vocabulary's merge
model once while it is remembered, as a piece or a part of one.  A full generation of pieces becomes the old one, from
which those in use come back.  `tests/llm` compares the result with the library's own encoding of whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import regex

SEQUENCE = 2048
#: Pieces and parts of pieces that each of the two generations of an encoder holds, and what is too long to be remembered.
CACHED, LONG = 400_000, 200


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces, learned where they are missing."""

    def __init__(self, learn: Callable[[str], bytes], cached: int) -> None:
        self.learn, self.cached, self.old = learn, cached, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.learn(piece)
        if len(self) >= self.cached:
            self.old = dict(self)
            self.clear()
        if len(piece) <= LONG:
            self[piece] = found
        return found


class Encoder:
    """Texts to little-endian uint32 ids as bytes."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = [s["type"] for s in (rules.get("normalizer") or {}).get("normalizers", [])]
        cut = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.known = steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cut] == ["Split", "ByteLevel"]
        self.pattern = regex.compile(cut[0]["pattern"]["Regex"]) if self.known else None
        self.model, self.letters = self.whole.model, _byte_letters()
        self.pieces = _Pieces(self._piece, cached)

    def _part(self, part: str) -> bytes:
        word = part if part.isascii() and part.isprintable() else part.encode().decode("latin1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not self.known or len(piece) > 2000:
            return np.array(self.whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if piece.isascii():
            low = piece.lower()
        else:
            low = piece if unicodedata.is_normalized("NFC", piece) else unicodedata.normalize("NFC", piece)
            # lower case is taken character by character, as the vocabulary does; str.lower() treats a final sigma apart
            low = low.lower() if "\u03a3" not in low else "".join(map(str.lower, low))
        parts = [low] if low.isascii() and low.isalpha() else self.pattern.findall(low)
        if parts == [piece]:
            return self._part(piece)
        # a part is cut and lowered no further, so that it is a piece of its own
        return self.pieces[parts[0]] if len(parts) == 1 else b"".join(map(self.pieces.__getitem__, parts))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        out, get = [], self.pieces.__getitem__
        for text in texts:
            text = text or ""
            # str.split() also cuts at U+001C to U+001F, which the vocabulary takes for ordinary characters
            odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
            out.append(b"".join(map(get, text.split(" ") if odd else text.split())))
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cached: int = CACHED) -> Encoder:
    """One encoder per worker process, vocabulary file and cache size."""
    if (path, cached) not in _encoders:
        _encoders[path, cached] = Encoder(path, cached)
    return _encoders[path, cached]
