"""Canonical records: identities of revisions and the exact bytes of an exported history.

A record is its number of fields and then the fields in ascending order, each as tag (twice its number, plus one where
it is critical), length and value.  Numbers are little-endian base-128 varints of minimal length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers of enum variants.
SOURCES = {"git": 0, "hg": 1, "svn": 2, "cvs": 3, "other": 4}
OPS = {"Add": 0, "Modify": 1, "Delete": 2, "Replace": 3}
DERIVATIONS = {"inferred-rename": 0, "reconstructed-changeset": 1, "reconstructed-branch": 2, "inferred-merge": 3, "normalized-metadata": 4, "other": 5}


class NonCanonical(ValueError):
    """Bytes that are not the one valid encoding of their value."""


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def svarint(n: int) -> bytes:
    return uvarint(n << 1 if n >= 0 else (-n << 1) - 1)


def read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise NonCanonical("a number does not end")
        b, at = data[at], at + 1
        n |= (b & 127) << shift
        if b < 128:
            if not b and shift:
                raise NonCanonical("a number is not minimal")
            if n >> 64:
                raise NonCanonical("a number is too large")
            return n, at
        shift += 7


def read_svarint(data: bytes, at: int) -> tuple[int, int]:
    n, at = read_uvarint(data, at)
    return (n >> 1) ^ -(n & 1), at


def record(fields: Iterable[tuple[int, bytes | None]]) -> bytes:
    """Fields (number, value) that are present; None leaves one out."""
    have = [(i, v) for i, v in fields if v is not None]
    return uvarint(len(have)) + b"".join(uvarint(i << 1 | 1) + uvarint(len(v)) + v for i, v in have)


def read_record(data: bytes, at: int, known: set[int]) -> tuple[dict[int, bytes], int, int]:
    """Fields, the end, and how many unknown non-critical ones were skipped; an unknown critical one is refused."""
    n, at = read_uvarint(data, at)
    out, last, skipped = {}, -1, 0
    for _ in range(n):
        tag, at = read_uvarint(data, at)
        size, at = read_uvarint(data, at)
        if tag <= last or at + size > len(data):
            raise NonCanonical("fields out of order or too long")
        last = tag
        if tag >> 1 in known:
            out[tag >> 1] = data[at : at + size]
        elif tag & 1:
            raise NonCanonical(f"unknown critical field {tag >> 1}")
        else:
            skipped += 1
        at += size
    return out, at, skipped


def some(items: list[bytes]) -> bytes | None:
    return uvarint(len(items)) + b"".join(items) if items else None


def mapping(pairs: dict[str, str] | None) -> bytes | None:
    rows = [(k.encode(), v.encode()) for k, v in (pairs or {}).items()]
    return some([uvarint(len(k)) + k + uvarint(len(v)) + v for k, v in sorted(rows)])


def text(t) -> bytes | None:
    return None if t is None else record([(1, bytes(t["bytes"])), (2, t["encoding"].encode() if t["encoding"] is not None else None)])


def when(t) -> bytes | None:
    return None if t is None else record([(1, svarint(int(t["seconds"]))), (2, svarint(int(t["offset_minutes"])) if t["offset_minutes"] is not None and t["offset_minutes"] == t["offset_minutes"] else None)])


def identity(i) -> bytes | None:
    return None if i is None else record([(1, text(i["name"])), (2, text(i["email"]))])


def status(s) -> bytes:
    """A status with its layers, outermost first, around a stated or derived base."""
    if s["base"] == "derived":
        d = s["derivation"]
        kind = DERIVATIONS.get(d["kind"], 5)
        out = uvarint(1) + record([
            (1, uvarint(kind) + record([(1, (d["kind_label"] or "").encode())] if kind == 5 else [])), (2, d["by"].encode()), (3, d["decoder_version"].encode()),
            (4, mapping(dict(d["params"] or {}))), (5, uvarint(int(d["confidence"])) if d["confidence"] is not None and d["confidence"] == d["confidence"] else None),
        ])
    else:
        out = uvarint(0) + record([])
    for layer in reversed(list(s["layers"]) if s["layers"] is not None else []):
        parts = [p.encode() for p in sorted(layer["changed"])]
        out = uvarint(2) + record([(1, uvarint(int(layer["step"]))), (2, some([uvarint(len(p)) + p for p in parts])), (3, out)])
    return out


def source(s, signatures: list | None = None, extras: list | None = None) -> bytes:
    kind = SOURCES.get(s["kind"], 4)
    pair = lambda x: record([(1, x["label"].encode()), (2, bytes(x["bytes"]))])
    return record([(1, uvarint(kind) + record([(1, (s["kind_label"] or "").encode())] if kind == 4 else [])), (2, bytes(s["repo_id"])), (3, bytes(s["id"])), (4, some([pair(x) for x in signatures or []])), (5, some([pair(x) for x in extras or []]))])


def op(o) -> bytes:
    if o["op"] == "Delete":
        fields = [(1, o["path"].encode()), (4, status(o["status"]))]
    else:
        fields = [(1, o["path"].encode()), (2, bytes(o["blob_id"])), (3, uvarint(int(o["mode"]))), (4, status(o["status"]))]
    return uvarint(OPS[o["op"]]) + record(fields)


def _own_fields(ops: list, atom) -> dict[int, bytes | None]:
    """Fields of a revision that no other revision's identity enters: ops, metadata, source and status."""
    meta = [(1, identity(atom["author"])), (2, when(atom["author_time"])), (3, identity(atom["committer"])), (4, when(atom["commit_time"])), (5, text(atom["message"]))]
    ordered = sorted(ops, key=lambda o: o["path"].encode())
    return {3: some([op(o) for o in ordered]), 5: record(meta) if any(v is not None for _, v in meta) else None, 6: source(atom["source"]), 7: status(atom["status"])}


def _linked(own: dict[int, bytes | None], parents: list[bytes], copies: list[tuple[str, bytes, str, bytes]]) -> list[tuple[int, bytes | None]]:
    """Fields 2 to 7; copies: from, from_atom, to and the encoded status."""
    rows = sorted(copies, key=lambda c: (c[2].encode(), c[0].encode(), c[1]))
    made = some([record([(1, c[0].encode()), (2, c[1]), (3, c[2].encode()), (4, c[3])]) for c in rows])
    return [(2, some([bytes(p) for p in parents])), (3, own[3]), (4, made), (5, own[5]), (6, own[6]), (7, own[7])]


def atom_body(parents: list[bytes], ops: list, copies: list, atom) -> list[tuple[int, bytes | None]]:
    """Fields 2 to 7 of a revision: everything that its identity covers."""
    return _linked(_own_fields(ops, atom), parents, [(c["from"], bytes(c["from_atom"]), c["to"], status(c["status"])) for c in copies])


def atom_id(parents: list[bytes], ops: list, copies: list, atom) -> bytes:
    return hashlib.sha256(record(atom_body(parents, ops, copies, atom))).digest()


def atom_ids(atoms: DataFrame, parents: DataFrame, ops: DataFrame, copies: DataFrame, group: str | None = None) -> DataFrame:
    """node, atom_id.  Parents' identities enter their children's, so identities are made in order of position.

    atoms: node, position and the claims; parents: node, pos, parent (a node); ops: node, ...; copies: node, from_node.
    All but the fields that hold identities is encoded in parallel.  One task per group (repository) then reads the
    encoded revisions in order, a batch at a time: it remembers identities, but neither ops nor messages.
    """
    packed = atoms.join(ops.groupBy("node").agg(F.collect_list(F.struct("path", "op", "blob_id", "mode", "status")).alias("ops")), "node", "left")
    packed = packed.join(copies.groupBy("node").agg(F.collect_list(F.struct("from", "from_node", "to", "status")).alias("copies")), "node", "left")
    packed = packed.join(parents.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parent"))), lambda x: x["parent"]).alias("parents")), "node", "left")
    kind = atoms.schema["node"].dataType.simpleString()
    plain = lambda v: bytes(v) if isinstance(v, bytearray | memoryview) else v
    listed = lambda v: [] if v is None else list(v)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                for k in ("author", "author_time", "committer", "commit_time", "message"):
                    r[k] = r[k] if isinstance(r[k], dict) else None
                own = _own_fields(listed(r["ops"]), r)
                copied = [{"from": c["from"], "from_node": plain(c["from_node"]), "to": c["to"], "status": status(c["status"])} for c in listed(r["copies"])]
                out.append((plain(r["node"]), r["position"], r["_group"], [plain(p) for p in listed(r["parents"])], copied, own[3], own[5], own[6], own[7]))
            yield pd.DataFrame(out, columns=["node", "position", "_group", "parents", "copies", "f3", "f5", "f6", "f7"])

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, made = None, {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r[2] != now:
                    now, made = r[2], {}
                own = {3: plain(r.f3), 5: plain(r.f5), 6: plain(r.f6), 7: plain(r.f7)}
                copied = [(c["from"], made[plain(c["from_node"])], c["to"], plain(c["status"])) for c in listed(r.copies)]
                made[plain(r.node)] = hashlib.sha256(record(_linked(own, [made[plain(p)] for p in listed(r.parents)], copied))).digest()
                out.append((plain(r.node), made[plain(r.node)]))
            yield pd.DataFrame(out, columns=["node", "atom_id"])

    key = (F.col(group) if group else F.lit(1)).cast("string")
    fields = f"node {kind}, position long, _group string, parents array<{kind}>, copies array<struct<`from`:string,from_node:{kind},`to`:string,status:binary>>, f3 binary, f5 binary, f6 binary, f7 binary"
    ready = packed.withColumn("_group", F.coalesce(key, F.lit(""))).mapInPandas(encode, fields)
    return ready.repartition("_group").sortWithinPartitions("_group", "position").mapInPandas(order, f"node {kind}, atom_id binary")


def varint_column(value: Column) -> Column:
    """uvarint of a non-negative BIGINT below 2**35 as BINARY."""
    def part(i: int) -> Column:
        low = F.shiftright(value, 7 * i).bitwiseAND(F.lit(127))
        return F.unhex(F.lpad(F.hex(F.when(value >= 1 << 7 * (i + 1), low.bitwiseOR(F.lit(128))).otherwise(low)), 2, "0"))

    return F.concat(*[F.when(F.lit(i == 0) | (value >= 1 << 7 * i), part(i)).otherwise(F.lit(b"")) for i in range(5)])


def frame_lengths(lengths: Iterable[int], limit: int = 1 << 20) -> Iterator[int]:
    """Raw lengths of frames: contents join the open frame while it stays within the limit; larger ones stand alone."""
    now = None
    for n in lengths:
        if n > limit:
            if now is not None:
                yield now
            yield n
            now = None
        elif now is not None and now + n <= limit:
            now += n
        else:
            if now is not None:
                yield now
            now = n
    if now is not None:
        yield now


def chunk_lengths(total: int, limit: int = 1 << 20) -> list[int]:
    """Fixed pieces of the metadata, the last one shorter."""
    return [limit] * (total // limit) + ([total % limit] if total % limit else [])


def deflated(raw: bytes) -> tuple[int, bytes]:
    """(codec, stored): raw DEFLATE at level 6 where that is smaller, else the bytes as they are."""
    import zlib

    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = c.compress(raw) + c.flush()
    return (1, packed) if len(packed) < len(raw) else (0, raw)


def inflated(codec: int, raw_len: int, stored: bytes) -> bytes:
    import zlib

    if codec == 0:
        if len(stored) != raw_len:
            raise NonCanonical("a stored frame has another length")
        return stored
    if codec != 1:
        raise NonCanonical(f"unknown frame codec {codec}")
    if raw_len > 1032 * len(stored) + 64:
        raise NonCanonical("a frame claims more than DEFLATE can hold")
    d = zlib.decompressobj(-15)
    out = d.decompress(stored, raw_len + 1)
    if len(out) != raw_len or not d.eof or d.unused_data:
        raise NonCanonical("a frame inflates to another length")
    return out


def container(magic: bytes, version: tuple[int, int, int], metadata: bytes, blobs: list[tuple[bytes, bytes]], pack: Callable[[bytes], tuple[int, bytes]] = deflated) -> bytes:
    """An artifact: magic, format 2, version, digest of the logical stream, metadata frames, blob table, blob frames."""
    v = b"".join(map(uvarint, version))
    rows = uvarint(len(blobs)) + b"".join(i + uvarint(len(b)) for i, b in blobs)
    content = b"".join(b for _, b in blobs)
    digest = hashlib.sha256(v + uvarint(len(metadata)) + metadata + rows + content).digest()

    def frames(data: bytes, sizes: list[int]) -> bytes:
        out, at = [uvarint(len(sizes))], 0
        for n in sizes:
            codec, stored = pack(data[at : at + n])
            out += [uvarint(codec), uvarint(n), uvarint(len(stored)), stored]
            at += n
        return b"".join(out)

    return magic + b"\x02" + v + digest + frames(metadata, chunk_lengths(len(metadata))) + rows + frames(content, list(frame_lengths(len(b) for _, b in blobs)))


def read_container(magic: bytes, data: bytes, readable: tuple[int, ...] = (3,)) -> tuple[tuple[int, int, int], bytes, list[tuple[bytes, bytes]]]:
    """version, metadata and blobs of an artifact; checked in the order magic, format, version, frames, digest, packing."""
    if data[: len(magic)] != magic:
        raise NonCanonical("not an artifact")
    at = len(magic)
    if data[at] != 2:
        raise NonCanonical(f"unknown artifact format {data[at]}")
    version, at = [], at + 1
    for _ in range(3):
        n, at = read_uvarint(data, at)
        version.append(n)
    if version[0] != 0 or version[1] not in readable:
        raise NonCanonical(f"contract {version[0]}.{version[1]} is not read")
    digest, at = data[at : at + 32], at + 32

    def frames(at: int) -> tuple[list[bytes], int]:
        n, at = read_uvarint(data, at)
        out = []
        for _ in range(n):
            codec, at = read_uvarint(data, at)
            raw, at = read_uvarint(data, at)
            size, at = read_uvarint(data, at)
            if at + size > len(data):
                raise NonCanonical("a frame does not end")
            out.append(inflated(codec, raw, data[at : at + size]))
            at += size
        return out, at

    meta, at = frames(at)
    start = at
    count, at = read_uvarint(data, at)
    rows = []
    for _ in range(count):
        i, at = data[at : at + 32], at + 32
        n, at = read_uvarint(data, at)
        rows.append((i, n))
    table = data[start:at]
    content, at = frames(at)
    metadata, body = b"".join(meta), b"".join(content)
    v = b"".join(map(uvarint, version))
    if hashlib.sha256(v + uvarint(len(metadata)) + metadata + table + body).digest() != digest:
        raise NonCanonical("the digest does not match")
    if at != len(data) or [len(f) for f in meta] != chunk_lengths(len(metadata)) or [len(f) for f in content] != list(frame_lengths(n for _, n in rows)):
        raise NonCanonical("frames do not match the packing rule")
    blobs, k = [], 0
    for i, n in rows:
        blobs.append((i, body[k : k + n]))
        if hashlib.sha256(body[k : k + n]).digest() != i:
            raise NonCanonical("a blob is not its id")
        k += n
    return tuple(version), metadata, blobs


def escape_invalid_utf8(value: bytes) -> str:
    """Text of bytes, those that are not UTF-8 as \\xNN."""
    return value.decode("utf-8", "backslashreplace")
