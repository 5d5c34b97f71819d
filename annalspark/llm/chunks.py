"""What a worker learns about strings, remembered within bounds, and texts cut into chunks that are learned one by one.

A space between two characters that are not white space starts a new chunk: the patterns that split text before the
merges give such a space to the word after it, and no piece of the word-boundary vocabularies holds a space behind
another character.  The tokens of a text are then those of its chunks one after another, and equal chunks are encoded
once while they are remembered.  Other white space stays inside the chunk it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

#: Keys, and characters or bytes of keys, that each of the two generations holds.
CACHED, CACHED_SIZE = 250_000, 12_000_000


class Remembered:
    """What `learn` makes of keys.  A full generation becomes the old one, from which keys in use come back unlearned."""

    def __init__(self, learn: Callable[[list], list[Any]], cached: int = CACHED) -> None:
        self.learn, self.cached = learn, cached
        self.now: dict[Any, Any] = {}
        self.old: dict[Any, Any] = {}
        self.size = 0

    def of(self, keys: Iterable[Iterable]) -> dict[Any, Any]:
        """A dict that has all keys of the given groups."""
        wanted = set().union(*keys)
        new = wanted.difference(self.now)
        if new and self.now and (len(self.now) + len(new) > self.cached or self.size > CACHED_SIZE):
            self.now, self.old, self.size, new = {}, self.now, 0, wanted
        if new:
            known, rest = [k for k in new if k in self.old], [k for k in new if k not in self.old]
            self.now.update(zip(known, map(self.old.__getitem__, known), strict=True))
            self.now.update(zip(rest, self.learn(rest), strict=True))
            self.size += sum(map(len, new))
        return self.now


class Chunks:
    """What `learn` makes of each chunk of texts that have a space before them.

    learn takes chunks, which start with that space.  `inner` holds characters that count as white space for the cuts.
    """

    def __init__(self, learn: Callable[[list[str]], list[Any]], *, inner: str = "", cached: int = CACHED) -> None:
        self.inner, self.learn = inner, learn
        self.chunks = Remembered(self._learn, cached)
        #: Pieces that touch white space, of both generations.
        self.open: set[str] = set()

    def _learn(self, new: list[str]) -> list[Any]:
        if len(self.open) > self.chunks.cached:
            self.open = {p for p in self.open if p in self.chunks.now or p in self.chunks.old}
        self.open.update(p for p in new if self._touches_space(p))
        return self.learn([" " + p for p in new])

    def _touches_space(self, piece: str) -> bool:
        return not piece or piece[0].isspace() or piece[-1].isspace() or piece[0] in self.inner or piece[-1] in self.inner

    def _joined(self, pieces: list[str]) -> list[str]:
        """Pieces on both sides of a space that touches other white space, put together again."""
        out, run, shut = [], [pieces[0]], pieces[0] in self.open
        for piece in pieces[1:]:
            opens = piece in self.open
            if shut or opens:
                run.append(piece)
            else:
                out.append(" ".join(run))
                run = [piece]
            shut = opens
        out.append(" ".join(run))
        return out

    def values(self, texts: list[str]) -> list[list[Any]]:
        """The values of each text's chunks, in order; an empty text has one chunk, a space."""
        split = [t.split(" ") for t in texts]
        found = self.chunks.of(split)
        cut = [i for i, p in enumerate(split) if not self.open.isdisjoint(p)]
        values = [list(map(found.__getitem__, p)) for p in split]
        joined = [self._joined(split[i]) for i in cut]
        found = self.chunks.of(joined)
        for i, p in zip(cut, joined, strict=True):
            values[i] = list(map(found.__getitem__, p))
        return values
