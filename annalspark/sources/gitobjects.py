"""Git objects as bytes: loose files, names, deltas and the heads of pack entries."""

from __future__ import annotations

import hashlib
import zlib

MAX_OBJECT = 1 << 30
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


class Malformed(ValueError):
    """A store that is not what its format says, or one that is not read."""


def loose(data: bytes) -> tuple[str, bytes]:
    raw = zlib.decompress(data)
    head, _, body = raw.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if kind.decode() not in KINDS.values() or int(size) != len(body):
        raise Malformed("not a loose object")
    return kind.decode(), body


def object_id(kind: str, body: bytes) -> bytes:
    return hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).digest()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b, at = data[at], at + 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    want, at = _varint(delta, 0)
    size, at = _varint(delta, at)
    if want != len(base) or size > MAX_OBJECT:
        raise Malformed("a delta for another base")
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            start = length = 0
            for i in range(4):
                if op >> i & 1:
                    start, at = start | delta[at] << 8 * i, at + 1
            for i in range(3):
                if op >> 4 + i & 1:
                    length, at = length | delta[at] << 8 * i, at + 1
            length = length or 0x10000
            if start + length > len(base):
                raise Malformed("a copy outside the base")
            out += base[start : start + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise Malformed("an unknown instruction")
    if len(out) != size:
        raise Malformed("a delta makes another size than it says")
    return bytes(out)


def entry_head(data: bytes, at: int, start: int = 0) -> tuple[int, int, int | bytes | None, int]:
    """Kind, size, base and first byte of the packed content of an entry that stands at `start` of data.

    The base is a place, counted from where `at` is the entry's own, or a name, or None.
    """
    b, i = data[start], start + 1
    kind, size, shift = b >> 4 & 7, b & 15, 4
    while b & 128:
        b, i = data[i], i + 1
        size |= (b & 127) << shift
        shift += 7
    base: int | bytes | None = None
    if kind == 6:
        b, i = data[i], i + 1
        back = b & 127
        while b & 128:
            b, i = data[i], i + 1
            back = (back + 1) << 7 | b & 127
        base = at - back
    elif kind == 7:
        base, i = bytes(data[i : i + 20]), i + 20
    elif kind not in KINDS:
        raise Malformed("an unknown object kind")
    return kind, size, base, i
