"""Packs read by their indexes."""

from __future__ import annotations

import hashlib
import random
import shutil
import struct
import subprocess
import zlib

import pytest

from annalspark.sources import gitstore, packs
from annalspark.sources.gitobjects import Malformed, object_id


def number(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def appended(base, more):
    """A delta that copies all of a base of less than 64 KB and adds up to 127 bytes."""
    return number(len(base)) + number(len(base) + len(more)) + bytes([0x80 | 0x30]) + struct.pack("<H", len(base)) + bytes([len(more)]) + more


def entry(kind, content, extra=b""):
    size, head = len(content) >> 4, [kind << 4 | len(content) & 15]
    while size:
        head[-1] |= 128
        head.append(size & 127)
        size >>= 7
    return bytes(head) + extra + zlib.compress(content)


def store(folder, name, parts, far=False):
    """A pack and its index; parts: (object id, entry)."""
    body, rows = b"PACK" + struct.pack(">II", 2, len(parts)), []
    for oid, data in parts:
        rows.append((oid, zlib.crc32(data), len(body)))
        body += data
    rows.sort()
    total = hashlib.sha1(body).digest()
    made = packs.MAGIC + b"".join(struct.pack(">I", sum(r[0][0] <= k for r in rows)) for k in range(256)) + b"".join(r[0] for r in rows) + b"".join(struct.pack(">I", r[1]) for r in rows)
    made += b"".join(struct.pack(">I", i | 1 << 31 if far else r[2]) for i, r in enumerate(rows)) + (b"".join(struct.pack(">Q", r[2]) for r in rows) if far else b"") + total
    at = folder / "objects/pack"
    at.mkdir(parents=True, exist_ok=True)
    (at / f"pack-{name}.pack").write_bytes(body + total)
    (at / f"pack-{name}.idx").write_bytes(made + hashlib.sha1(made).digest())


def found(spark, folder):
    return {bytes(r["oid"]): (r["kind"], bytes(r["content"])) for r in gitstore.read(spark, str(folder))["objects"].collect()}


@pytest.mark.parametrize("far", [False, True])
def test_thin_packs_are_completed_from_the_store(spark, tmp_path, far):
    base, lone = b"a base\n" * 200, b"a loose base\n" * 100
    ids = {k: object_id("blob", v) for k, v in (("base", base), ("lone", lone), ("x", base + b"x"), ("xy", base + b"xy"), ("z", lone + b"z"))}
    store(tmp_path, "aa", [(ids["base"], entry(3, base)), (object_id("blob", b""), entry(3, b""))], far)
    deltas = [(ids["xy"], entry(7, appended(base + b"x", b"y"), ids["x"])), (ids["x"], entry(7, appended(base, b"x"), ids["base"])), (ids["z"], entry(7, appended(lone, b"z"), ids["lone"]))]
    store(tmp_path, "bb", deltas, far)
    store(tmp_path, "cc", [(ids["base"], entry(3, base)), (ids["xy"], entry(3, base + b"xy"))], far)
    (tmp_path / "refs/heads").mkdir(parents=True)
    name = ids["lone"].hex()
    (tmp_path / "objects" / name[:2]).mkdir()
    (tmp_path / "objects" / name[:2] / name[2:]).write_bytes(zlib.compress(f"blob {len(lone)}\0".encode() + lone))
    rows = gitstore.read(spark, str(tmp_path))["objects"].collect()
    assert len(rows) == 6 and {bytes(r["oid"]): bytes(r["content"]) for r in rows} == {object_id("blob", c): c for c in (base, lone, b"", base + b"x", base + b"xy", lone + b"z")}
    shutil.rmtree(tmp_path / "objects" / name[:2])
    with pytest.raises(Malformed, match="without its base"):
        found(spark, tmp_path)


def test_circles_and_damage_are_refused(spark, tmp_path):
    a, b = object_id("blob", b"aa"), object_id("blob", b"aab")
    store(tmp_path / "one", "aa", [(a, entry(7, appended(b"aab", b""), b)), (b, entry(7, appended(b"aa", b"b"), a))])
    with pytest.raises(Malformed, match="bases of each other"):
        found(spark, tmp_path / "one")
    store(tmp_path / "two", "aa", [(a, entry(3, b"aa"))])
    file = tmp_path / "two/objects/pack/pack-aa.pack"
    data = bytearray(file.read_bytes())
    data[16] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        found(spark, tmp_path / "two")
    store(tmp_path / "three", "aa", [(b, entry(3, b"aa"))])
    with pytest.raises(Exception, match="does not hash"):
        found(spark, tmp_path / "three")
    with pytest.raises(Malformed, match="not an index"):
        packs.index(b"\xfftOc" + bytes(1100), 100)


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_packs_of_the_tool_itself(spark, tmp_path, monkeypatch):
    """Chains of 50, entries by place; ranges of 4 KB, so that chains leave them."""
    monkeypatch.setattr(packs, "RANGE_BITS", 12)
    rng = random.Random(3)
    lines = [f"line {i} {rng.random()}\n" for i in range(300)]
    out = []
    for n in range(400):
        lines[rng.randrange(300)] = f"changed {n} {rng.random()}\n"
        text = "".join(lines)
        out.append(f"commit refs/heads/main\ncommitter C <c@x> {n} +0000\ndata 1\nm\nM 644 inline f{n % 3}\ndata {len(text)}\n{text}\n")
    run = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, **k).stdout
    run("init", "-q", "--bare", ".")
    run("fast-import", "--quiet", input="".join(out).encode())
    run("repack", "-adfq", "--depth=50")
    (file,) = (tmp_path / "objects/pack").glob("*.pack")
    want = {object_id(k, c): (k, c) for k, c in gitstore.pack(file.read_bytes())}
    assert len(want) == int(run("count-objects", "-v").decode().split("in-pack: ")[1].split()[0]) >= 1200
    assert found(spark, tmp_path) == want
    file.with_suffix(".idx").unlink()
    assert found(spark, tmp_path) == want  # as one row
