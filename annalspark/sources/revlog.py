"""Mercurial stores: revlogs, changelog, manifests, phases, bookmarks and obsolescence markers."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_REVISION = 1 << 30
NULL = b"\0" * 20
_ENTRY = struct.Struct(">Qiiiiii20s12x")
# Store formats that this reader takes, and those that change what a store means.
SUPPORTED = frozenset({"revlogv1", "store", "fncache", "dotencode", "generaldelta", "sparserevlog", "revlog-compression-zstd", "persistent-nodemap", "share-safe"})
FLOOR = frozenset({"largefiles", "lfs", "narrowhg-experimental", "treemanifest", "exp-sparse", "internal-phase"})


class Malformed(ValueError):
    """A store that is not what its format says."""


def check_requirements(text: str) -> None:
    for r in text.split():
        if r in FLOOR:
            raise Malformed(f"a store with {r} is not read")
        if r not in SUPPORTED:
            raise Malformed(f"unknown requirement {r}")


def inflate(chunk: bytes, limit: int = MAX_REVISION) -> bytes:
    """A chunk by its first byte: zlib, Zstandard, plain after `u`, or as it is from NUL on."""
    if not chunk:
        return b""
    if chunk[:1] == b"u":
        return chunk[1:]
    if chunk[:1] == b"\0":
        return chunk
    if chunk[:1] == b"x":
        d = zlib.decompressobj()
        try:
            out = d.decompress(chunk, limit + 1)
        except zlib.error as e:
            raise Malformed("a chunk does not inflate") from e
        if len(out) > limit or not d.eof:
            raise Malformed("a chunk is too large or does not end")
        return out
    if chunk[:1] == b"\x28":
        import zstandard

        try:
            out = zstandard.ZstdDecompressor().decompressobj().decompress(chunk)
        except zstandard.ZstdError as e:
            raise Malformed("a chunk does not inflate") from e
        if len(out) > limit:
            raise Malformed("a chunk is too large")
        return out
    raise Malformed("unknown compression")


def patch(base: bytes, delta: bytes, limit: int = MAX_REVISION) -> bytes:
    """Replaces the delta's (start, end) ranges of the base; ranges ascend and do not overlap."""
    out, at, i, size = [], 0, 0, 0
    while i < len(delta):
        if i + 12 > len(delta):
            raise Malformed("a hunk does not end")
        start, end, n = struct.unpack_from(">III", delta, i)
        i += 12
        if start < at or end < start or end > len(base) or i + n > len(delta):
            raise Malformed("a hunk outside its base")
        out += [base[at:start], delta[i : i + n]]
        size += start - at + n
        if size > limit:
            raise Malformed("the revision is larger than the ceiling")
        at, i = end, i + n
    return b"".join([*out, base[at:]])


def entries(index: bytes, data: bytes | None = None) -> list[dict]:
    """Index entries with their chunks, for inline and split revlogs."""
    if not index:
        return []
    inline = bool(struct.unpack_from(">I", index, 0)[0] & 0x10000)
    general = bool(struct.unpack_from(">I", index, 0)[0] & 0x20000)
    out, at = [], 0
    while at < len(index):
        if at + 64 > len(index):
            raise Malformed("the index does not end at an entry")
        where, packed, size, base, link, p1, p2, node = _ENTRY.unpack_from(index, at)
        flags, start = where & 0xFFFF, (where >> 16) if out else 0
        at += 64
        chunk = index[at : at + packed] if inline else (data or b"")[start : start + packed]
        if len(chunk) != packed:
            raise Malformed("a chunk lies outside the data")
        at += packed if inline else 0
        if not -1 <= p1 < len(out) or not -1 <= p2 < len(out) or not -1 <= base <= len(out):
            raise Malformed("a parent or base is not an earlier revision")
        out.append({"rev": len(out), "flags": flags, "size": size, "base": base, "link": link, "p1": p1, "p2": p2, "node": node, "chunk": chunk, "general": general})
    return out


def texts(index: bytes, data: bytes | None = None) -> Iterator[tuple[dict, bytes]]:
    """Every entry with its full text; each delta is applied once, and each text must have its node's hash."""
    done: list[bytes] = []
    rows = entries(index, data)
    for e in rows:
        raw = inflate(e["chunk"])
        if e["base"] == e["rev"] or e["base"] == -1:
            text = raw
        else:
            text = patch(done[e["base"] if e["general"] else e["rev"] - 1], raw)
        if e["size"] >= 0 and len(text) != e["size"]:
            raise Malformed("a revision has another length than its entry says")
        a, b = sorted((rows[e["p1"]]["node"] if e["p1"] >= 0 else NULL, rows[e["p2"]]["node"] if e["p2"] >= 0 else NULL))
        if hashlib.sha1(a + b + text).digest() != e["node"]:
            raise Malformed("a revision does not have its node's hash")
        done.append(text)
        yield e, text


def extras(field: bytes) -> list[tuple[str, bytes]]:
    """NUL-separated key:value pairs in stored order, escapes undone; a key may not repeat."""
    out = []
    for part in field.split(b"\0"):
        plain, i = bytearray(), 0
        while i < len(part):
            if part[i : i + 1] == b"\\" and i + 1 < len(part):
                c = part[i + 1 : i + 2]
                plain += {b"n": b"\n", b"r": b"\r", b"0": b"\0", b"\\": b"\\"}.get(c, b"\\" + c)
                i += 2
            else:
                plain += part[i : i + 1]
                i += 1
        key, sep, value = bytes(plain).partition(b":")
        if not sep or key.decode() in [k for k, _ in out]:
            raise Malformed("an extra without a value, or twice")
        out.append((key.decode(), value))
    return out


def changeset(text: bytes) -> dict:
    """Fields of a changelog entry; an empty one is the null changeset."""
    head, sep, description = text.partition(b"\n\n")
    rows = head.split(b"\n")
    if not sep or len(rows) < 3:
        raise Malformed("a changelog entry is too short")
    when = rows[2].split(b" ", 2)
    pairs = extras(when[2]) if len(when) > 2 and when[2] else []
    return {"manifest": bytes.fromhex(rows[0].decode()), "user": rows[1], "time": int(when[0]), "tz": int(when[1]), "branch": dict(pairs).get("branch", b"default").decode(), "extras": pairs, "description": description}


def manifest(text: bytes) -> dict[str, tuple[bytes, int]]:
    """path to (file node, mode)."""
    out = {}
    for row in text.split(b"\n")[:-1]:
        path, sep, rest = row.partition(b"\0")
        if not sep or len(rest) < 40:
            raise Malformed("a manifest row is too short")
        flag = rest[40:]
        if flag not in (b"", b"x", b"l"):
            raise Malformed("an unknown manifest flag")
        out[path.decode()] = (bytes.fromhex(rest[:40].decode()), {b"": 0o100644, b"x": 0o100755, b"l": 0o120000}[flag])
    return out


def file_text(text: bytes) -> tuple[dict[str, str], bytes]:
    """Copy metadata and content of a file revision."""
    if text[:2] != b"\1\n":
        return {}, text
    end = text.find(b"\1\n", 2)
    if end < 0:
        raise Malformed("metadata does not end")
    return dict(row.decode().split(": ", 1) for row in text[2:end].split(b"\n") if row), text[end + 2 :]


def phase_roots(text: bytes) -> list[tuple[int, bytes]]:
    return [(int(p), bytes.fromhex(n.decode())) for p, n in (row.split() for row in text.splitlines() if row.strip())]


def bookmarks(text: bytes) -> list[tuple[str, bytes]]:
    return [(name.decode(), bytes.fromhex(node.decode())) for node, _, name in (row.partition(b" ") for row in text.split(b"\n") if row)]


def obsolete(data: bytes) -> set[bytes]:
    """Precursors in a version-1 marker store."""
    if not data:
        return set()
    if data[0] != 1:
        raise Malformed("unknown marker store version")
    out, at = set(), 1
    fixed = struct.Struct(">IdhHBBB20s")
    while at < len(data):
        if at + fixed.size > len(data):
            raise Malformed("a marker does not end")
        total, _, _, flags, n_succ, n_par, n_meta, precursor = fixed.unpack_from(data, at)
        width = 32 if flags & 2 else 20
        parents = 0 if n_par == 3 else n_par
        if width != 20 or total < fixed.size + 20 * (n_succ + parents) + 2 * n_meta or at + total > len(data):
            raise Malformed("a marker has a wrong size")
        out.add(precursor)
        at += total
    return out


# Lengths of the store's hashed names, reserved characters, device names.
LONGEST, FOLDER, FOLDERS = 120, 8, 68
_RESERVED, _DEVICES, _NUMBERED = frozenset('\\:*?"<>|'), frozenset(("con", "prn", "aux", "nul")), frozenset(("com", "lpt"))


def _tilde(c: str) -> str:
    return f"~{ord(c):02x}"


def _safe(name: str) -> str:
    """A component without device names and without dots and spaces at its ends."""
    base = name.split(".", 1)[0]
    if name[:1] in (".", " "):
        name = _tilde(name[0]) + name[1:]
    elif base in _DEVICES or (len(base) == 4 and base[:3] in _NUMBERED and base[3] in "123456789"):
        name = name[:2] + _tilde(name[2]) + name[3:]
    return name[:-1] + _tilde(name[-1]) if name[-1:] in (".", " ") else name


def store_name(entry: str) -> str:
    """The store's name of an entry such as data/a/b.c.i: reversible while it is short, else hashed."""
    text = entry.encode().decode("latin1")
    for end in (".hg/", ".i/", ".d/"):
        text = text.replace(end, f"{end[:-1]}.hg/")
    plain = lambda c: _tilde(c) if ord(c) < 32 or ord(c) > 125 or c in _RESERVED else c
    full = "".join("_" + c.lower() if "A" <= c <= "Z" else "__" if c == "_" else plain(c) for c in text)
    full = "/".join(map(_safe, full.split("/")))
    if len(full) <= LONGEST:
        return full
    digest = hashlib.sha1(text.encode("latin1")).hexdigest()
    _, *folders, last = map(_safe, "".join(c.lower() if "A" <= c <= "Z" else plain(c) for c in text).split("/"))
    short, size = [], -1
    for folder in folders:
        cut = folder[:FOLDER]
        cut = cut[:-1] + "_" if cut[-1:] in (".", " ") else cut
        size += 1 + len(cut)
        if short and size > FOLDERS:
            break
        short.append(cut)
    head = "/".join(["dh", *short]) + "/"
    dot = last.rfind(".")
    tail = digest + (last[dot:] if last[:dot].strip(".") and dot > 0 else "")
    return head + last[: max(0, LONGEST - len(head) - len(tail))] + tail


def store_path(path: str) -> str:
    """The store's name of a file's index."""
    return store_name(f"data/{path}.i")


def read(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """changelog, manifest_entries and file_revisions of a store folder; each revlog is one row and task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, index, data in zip(pdf["name"], pdf["index"], pdf["data"], strict=True):
                for e, text in texts(bytes(index), bytes(data) if data is not None else None):
                    rows.append((name, e["rev"], e["node"], e["link"], e["p1"], e["p2"], text))
            yield pd.DataFrame(rows, columns=["name", "rev", "node", "link", "p1", "p2", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store).selectExpr("regexp_extract(path, '([^:]*)$', 1) as path", "content")
    for (needs,) in files.filter("path like '%/requires'").select(F.decode("content", "UTF-8")).collect():  # one small file, or none
        check_requirements(needs)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                entries = bytes(content).decode().splitlines()
                rows = [(n, e) for e in entries if (n := store_name(e)).startswith("dh/")]
                yield pd.DataFrame(rows, columns=["stored", "entry"])

    # a hashed index and its data have names that differ; the list of entries says what belongs together
    entries = files.filter("path like '%/fncache'").select("content").mapInPandas(hashed, "stored string, entry string").distinct()
    files = files.withColumn("stored", F.regexp_extract("path", "/(dh/.*)$", 1)).join(entries, "stored", "left")
    files = files.withColumn("path", F.when(F.col("entry").isNotNull(), F.concat(F.regexp_extract("path", "^(.*/)dh/", 1), "entry")).otherwise(F.col("path")))
    index = files.filter("path like '%.i'").selectExpr("left(path, length(path) - 2) as name", "content as index")
    data = files.filter("path like '%.d'").selectExpr("left(path, length(path) - 2) as name", "content as data")
    raw = index.join(data, "name", "left").mapInPandas(run, "name string, rev int, node binary, link int, p1 int, p2 int, text binary")

    def logs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                c = changeset(bytes(r.text))
                rows.append((r.rev, bytes(r.node), r.p1, r.p2, c["manifest"], c["user"], c["time"], c["tz"], c["branch"], [{"k": k, "v": v} for k, v in c["extras"]], c["description"]))
            yield pd.DataFrame(rows, columns=["rev", "node", "p1", "p2", "manifest", "user", "time", "tz", "branch", "extras", "description"])

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                found = manifest(bytes(r.text))
                yield pd.DataFrame([(bytes(r.node), p, n, m) for p, (n, m) in found.items()], columns=["manifest", "path", "filenode", "mode"])

    return {
        "changelog": raw.filter("name like '%/00changelog'").mapInPandas(logs, "rev int, node binary, p1 int, p2 int, manifest binary, user binary, time bigint, tz bigint, branch string, extras array<struct<k:string,v:binary>>, description binary"),
        "manifest_entries": raw.filter("name like '%/00manifest'").mapInPandas(trees, "manifest binary, path string, filenode binary, mode int"),
        "file_revisions": raw.filter("name not like '%/00changelog' and name not like '%/00manifest'"),
    }
