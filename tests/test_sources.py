"""Readers of the four source formats on stores built here byte by byte."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalspark.functions import canon
from annalspark.operators import cluster
from annalspark.sources import gitstore, rcs, revlog, svndump

RCS = b"""head\t1.2;
access;
symbols
\tREL:1.1
\tBR:1.1.0.2;
locks; strict;
comment\t@# @;


1.2
date\t2024.01.02.03.04.05;\tauthor bob;\tstate Exp;
branches;
next\t1.1;

1.1
date\t99.01.02.03.04.05;\tauthor alice;\tstate Exp;
branches
\t1.1.2.1;
next\t;

1.1.2.1
date\t2024.01.03.00.00.00;\tauthor carol;\tstate dead;
branches;
next\t;


desc
@@


1.2
log
@second @@ time
@
text
@one
two
three
@


1.1
log
@first
@
text
@d2 2
a3 1
last
@


1.1.2.1
log
@branch
@
text
@a1 1
added
@
"""


def test_rcs():
    file = rcs.parse(RCS)
    assert file["symbols"] == [("REL", (1, 1)), ("BR", (1, 1, 0, 2))] and file["texts"][1, 2][0] == b"second @ time\n"
    assert rcs.contents(file) == {(1, 2): b"one\ntwo\nthree\n", (1, 1): b"one\nlast\n", (1, 1, 2, 1): b"one\nadded\nlast\n"}
    for script in (b"d2\n", b"d9 1\n", b"a9 1\nx\n", b"d2 1\nd1 1\n", b"a1 2\nx\n", b"q1 1\n"):
        with pytest.raises(rcs.Malformed):
            rcs.edit([b"a\n", b"b\n"], script)


def test_cvs_repository(spark, tmp_path):
    (tmp_path / "mod/Attic").mkdir(parents=True)
    (tmp_path / "CVSROOT").mkdir()
    (tmp_path / "mod/a.c,v").write_bytes(RCS)
    (tmp_path / "mod/Attic/b.c,v").write_bytes(RCS)
    (tmp_path / "CVSROOT/x,v").write_bytes(b"junk")
    tables = rcs.read(spark, str(tmp_path))
    assert {r["path"] for r in tables["files"].collect()} == {"mod/a.c", "mod/b.c"}
    assert tables["revisions"].filter("size(rev) = 2 and rev[1] = 2").first()["date"] == 1704164645
    assert tables["symbols"].count() == 4
    made = cluster.changesets(tables["revisions"].filter("size(rev) = 2")).collect()
    assert sorted(r["n_revs"] for r in made) == [2, 2] and all(r["confidence"] == 100 for r in made)
    (tmp_path / "mod/Attic/a.c,v").write_bytes(RCS)
    with pytest.raises(rcs.Malformed, match="Attic"):
        rcs.read(spark, str(tmp_path))


def props(*pairs):
    return b"".join(b"K %d\n%s\nV %d\n%s\n" % (len(k), k, len(v), v) for k, v in pairs) + b"PROPS-END\n"


def node(path, action, text=None, **headers):
    out = f"Node-path: {path}\nNode-kind: file\nNode-action: {action}\n".encode()
    for k, v in headers.items():
        out += f"{k.replace('_', '-')}: {v}\n".encode()
    if text is not None:
        out += b"Text-content-length: %d\nContent-length: %d\n" % (len(text), len(text))
    return out + b"\n" + (text or b"") + b"\n\n"


def number(n):
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def test_svn_stream(spark, tmp_path):
    base, want = b"one\n", b"one\none\none\nx"
    ops = bytes([0 << 6 | 4]) + number(0) + bytes([1 << 6 | 8]) + number(0) + bytes([2 << 6 | 1])
    delta = b"SVN\0" + number(0) + number(4) + number(len(want)) + number(len(ops)) + number(1) + ops + b"x"
    assert svndump.svndiff(delta, base) == want
    p = props((b"svn:author", b"carol"), (b"svn:log", b"add"))
    stream = b"SVN-fs-dump-format-version: 3\n\nUUID: u\n\nRevision-number: 1\nProp-content-length: %d\nContent-length: %d\n\n%s\n" % (len(p), len(p), p)
    stream += node("a.txt", "add", base, **{"Text-content-md5": hashlib.md5(base).hexdigest()})
    stream += b"Revision-number: 2\n\n" + node("a.txt", "change", delta, **{"Text-delta": "true", "Text-content-sha1": hashlib.sha1(want).hexdigest()})
    stream += node("b.txt", "add", **{"Node-copyfrom-rev": "1", "Node-copyfrom-path": "a.txt"})
    (tmp_path / "d.dump").write_bytes(stream)
    tables = svndump.read(spark, str(tmp_path / "d.dump"))
    assert [r["number"] for r in tables["revisions"].orderBy("number").collect()] == [1, 2]
    assert {r["k"]: bytes(r["v"]) for r in tables["revisions"].filter("number = 1").first()["props"]} == {"svn:author": b"carol", "svn:log": b"add"}
    assert [(r["path"], bytes(r["text"])) for r in tables["nodes"].orderBy("revision", "ord").collect()] == [("a.txt", base), ("a.txt", want), ("b.txt", base)]
    for broken in (delta[:-1], b"SVN\1" + delta[4:], delta[:4] + number(9) + delta[5:]):
        with pytest.raises(svndump.Malformed):
            svndump.svndiff(broken, base)


def make_revlog(texts, deltas=True, inline=True):
    index, data, nodes, done = b"", b"", [], []
    for i, t in enumerate(texts):
        p1 = i - 1
        node = hashlib.sha1(min(revlog.NULL, nodes[-1] if nodes else revlog.NULL) + max(revlog.NULL, nodes[-1] if nodes else revlog.NULL) + t).digest()
        if deltas and i:
            raw, base = struct.pack(">III", 0, len(done[-1]), len(t)) + t, i - 1
        else:
            raw, base = t, i
        chunk = zlib.compress(raw) if i % 2 else b"u" + raw
        offset = len(data)
        head = struct.pack(">Qiiiiii20s12x", offset << 16, len(chunk), len(t), base, i, p1, -1, node)
        if not i:
            head = struct.pack(">I", 1 | (0x10000 if inline else 0) | 0x20000) + head[4:]
        index += head + (chunk if inline else b"")
        data += chunk
        nodes.append(node)
        done.append(t)
    return index, data, nodes


@pytest.mark.parametrize("inline", [True, False])
def test_revlog(inline):
    texts = [b"one", b"one two", b"", b"three\n" * 50]
    index, data, nodes = make_revlog(texts, inline=inline)
    assert [t for _, t in revlog.texts(index, data)] == texts and [e["node"] for e in revlog.entries(index, data)] == nodes
    with pytest.raises((revlog.Malformed, zlib.error)):
        list(revlog.texts(index.replace(b"uone", b"uoNe"), data.replace(b"uone", b"uoNe")))


def test_mercurial_store(spark, tmp_path):
    files = make_revlog([b"\1\ncopy: old\n\1\nhello"])
    trees = make_revlog([b"a.txt\0" + files[2][0].hex().encode() + b"x\n"])
    logs = make_revlog([trees[2][0].hex().encode() + b"\nAl <al@x>\n1000 -3600 branch:dev\0k:a\\nb\na.txt\n\nhi"])
    (tmp_path / "data").mkdir()
    for name, (index, data, _) in (("00changelog", logs), ("00manifest", trees)):
        (tmp_path / f"{name}.i").write_bytes(index)
    (tmp_path / "data/a.txt.i").write_bytes(files[0])
    tables = revlog.read(spark, str(tmp_path))
    log = tables["changelog"].first()
    assert (log["branch"], log["tz"], bytes(log["description"]), [(r["k"], bytes(r["v"])) for r in log["extras"]]) == ("dev", -3600, b"hi", [("branch", b"dev"), ("k", b"a\nb")])
    entry = tables["manifest_entries"].first()
    assert (entry["path"], entry["mode"], bytes(entry["filenode"])) == ("a.txt", 0o100755, files[2][0])
    assert revlog.file_text(bytes(tables["file_revisions"].first()["text"])) == ({"copy": "old"}, b"hello")
    assert revlog.bookmarks(b"00ff name x\n") == [("name x", b"\0\xff")] and revlog.phase_roots(b"1 00ff\n") == [(1, b"\0\xff")]
    assert revlog.store_path("Foo/aux.c") == "data/_foo/au~78.c.i" and revlog.store_path("a.i/b_c") == "data/a.i.hg/b__c.i"
    marker = struct.pack(">IdhHBBB20s", 39 + 20, 0.0, 0, 0, 1, 3, 0, b"p" * 20) + b"s" * 20
    assert revlog.obsolete(b"\1" + marker) == {b"p" * 20}
    with pytest.raises(revlog.Malformed):
        revlog.check_requirements("revlogv1\nlargefiles")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def pack_entry(kind, size, extra, content):
    first, rest, out = kind << 4 | size & 15, size >> 4, b""
    while rest:
        out, first, rest = out + bytes([first | 128]), rest & 127, rest >> 7
    return out + bytes([first]) + extra + zlib.compress(content)


def test_git_store(spark, tmp_path):
    base, want = b"hello world\n" * 3, b"hello world\n" * 2 + b"end"
    delta = varint(len(base)) + varint(len(want)) + bytes([0x80 | 0x10, 24]) + bytes([3]) + b"end"
    assert gitstore.apply_delta(base, delta) == want
    blob, two = gitstore.object_id("blob", base), gitstore.object_id("blob", want)
    sub = b"100755 x\0" + two
    top = b"100644 a\0" + blob + b"40000 d\0" + gitstore.object_id("tree", sub)
    commit = b"tree " + gitstore.object_id("tree", top).hex().encode() + b"\nauthor A <a@x> 5 +0100\ncommitter C <c@x> 6 -0030\ngpgsig line\n more\n\nmsg\n"
    cid = gitstore.object_id("commit", commit)
    tag = b"object " + cid.hex().encode() + b"\ntype commit\ntag v1\ntagger A <a@x> 5 +0000\n\nrel"
    tid = gitstore.object_id("tag", tag)
    entries = [pack_entry(3, len(base), b"", base), pack_entry(7, len(delta), blob, delta), pack_entry(2, len(sub), b"", sub)]
    body = b"PACK" + (2).to_bytes(4) + len(entries).to_bytes(4) + b"".join(entries)
    (tmp_path / "objects/pack").mkdir(parents=True)
    (tmp_path / "objects/pack/pack-00.pack").write_bytes(body + hashlib.sha1(body).digest())
    for kind, content in (("tree", top), ("commit", commit), ("tag", tag)):
        oid = gitstore.object_id(kind, content).hex()
        (tmp_path / "objects" / oid[:2]).mkdir(exist_ok=True)
        (tmp_path / "objects" / oid[:2] / oid[2:]).write_bytes(zlib.compress(f"{kind} {len(content)}\0".encode() + content))
    (tmp_path / "refs/heads").mkdir(parents=True)
    (tmp_path / "refs/heads/main").write_text(cid.hex() + "\n")
    (tmp_path / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / "packed-refs").write_text(f"# pack-refs\n{tid.hex()} refs/tags/v1\n{'0' * 40} refs/heads/main\n")
    t = gitstore.read(spark, str(tmp_path))
    assert t["objects"].count() == 6
    row = t["commits"].first()
    assert (bytes(row["author_name"]), row["commit_offset"], bytes(row["message"]), [(e["k"], bytes(e["v"])) for e in row["extra"]]) == (b"A", "-0030", b"msg\n", [("gpgsig", b"line\nmore")])
    refs = {r["name"]: r for r in t["refs"].collect()}
    assert bytes(refs["refs/heads/main"]["oid"]) == cid and refs["HEAD"]["symbolic"] == "refs/heads/main" and bytes(refs["refs/tags/v1"]["oid"]) == tid
    assert {r["name"]: (bytes(r["target"]), r["hops"]) for r in gitstore.peeled(t["refs"], t["tags"]).collect()} == {"refs/heads/main": (cid, 0), "refs/tags/v1": (cid, 1)}
    tree = gitstore.snapshot(t["tree_entries"], t["commits"].select(F.col("tree").alias("root"))).collect()
    assert {(r["path"], bytes(r["oid"]), r["mode"]) for r in tree} == {("a", blob, 0o100644), ("d/x", two, 0o100755)}
    for names, config in (({"shallow"}, ""), (set(), "[extensions]\n objectformat = sha256")):
        with pytest.raises(gitstore.Malformed):
            gitstore.check_layout(names, config)


def test_canonical_numbers_and_records():
    for n in (0, 1, 127, 128, 300, 2**32, 2**64 - 1):
        assert canon.read_uvarint(canon.uvarint(n), 0) == (n, len(canon.uvarint(n)))
    for n in (0, -1, 1, -64, 64, -(2**63), 2**63 - 1):
        assert canon.read_svarint(canon.svarint(n), 0)[0] == n
    for bad in (b"\x80\x00", b"\x80", b"\xff" * 10 + b"\x01"):
        with pytest.raises(canon.NonCanonical):
            canon.read_uvarint(bad, 0)
    r = canon.record([(1, b"a"), (2, None), (5, b"")])
    assert canon.read_record(r, 0, {1, 5}) == ({1: b"a", 5: b""}, len(r), 0)
    with pytest.raises(canon.NonCanonical, match="critical"):
        canon.read_record(r, 0, {1})
    assert canon.read_record(b"\x01\x08\x01x", 0, {1}) == ({}, 4, 1)


def test_the_worked_example():
    # the format page's one-atom history: path "a", content "hi"
    blob = hashlib.sha256(b"hi").digest()
    stated = {"base": "stated", "derivation": None, "layers": []}
    atom = {"author": None, "author_time": None, "committer": None, "commit_time": None, "message": None, "source": {"kind": "git", "kind_label": None, "repo_id": b"", "id": b""}, "status": stated}
    ops = [{"path": "a", "op": "Add", "blob_id": blob, "mode": 0o100644, "status": stated}]
    assert canon.atom_id([], ops, [], atom).hex() == "8df0ce43525d8aa73fa1a9af119cc33c9d3b1ca6f0742ad80e1c52aa259ae66e"


def test_container_round_trip():
    rng = np.random.default_rng(0)
    blobs = [(hashlib.sha256(b).digest(), b) for b in (b"", b"hi", b"x" * 3_000_000, rng.bytes(900_000), rng.bytes(200_000))]
    data = canon.container(b"MAGIC", (0, 3, 0), b"m" * 2_500_000, blobs)
    version, meta, back = canon.read_container(b"MAGIC", data)
    assert (version, meta, back) == ((0, 3, 0), b"m" * 2_500_000, blobs)
    assert list(canon.frame_lengths([0, 2, 3_000_000, 900_000, 200_000])) == [2, 3_000_000, 900_000, 200_000] and canon.chunk_lengths(2_500_000) == [1 << 20, 1 << 20, 2_500_000 - (2 << 20)]
    for k in (0, 5, 6, 20, len(data) // 2, len(data) - 1):
        with pytest.raises((canon.NonCanonical, zlib.error, IndexError)):
            canon.read_container(b"MAGIC", data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])


def test_atom_ids_follow_the_parents(spark):
    from annalspark.history import SCHEMAS

    status = ("stated", None, [])
    fields = SCHEMAS["atoms"].replace("atom_id binary, atom_idx bigint", "node int, position int")
    atoms = spark.createDataFrame([(i, i, ("git", None, b"r", bytes([i])), None, (i, 0), None, None, (b"m", None), status) for i in range(3)], fields)
    ops = spark.createDataFrame([(i, "p", "Modify" if i else "Add", bytes(32), 33188, status) for i in range(3)], SCHEMAS["ops"].replace("atom_id binary", "node int"))
    copies = spark.createDataFrame([], SCHEMAS["copies"].replace("atom_id binary", "node int").replace("from_atom binary", "from_node int"))
    parents = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 1, 0)], "node int, pos int, parent int")
    ids = {r["node"]: bytes(r["atom_id"]) for r in canon.atom_ids(atoms, parents, ops, copies).collect()}
    rows = {r["node"]: r.asDict(recursive=True) for r in atoms.collect()}
    for n, up in ((0, []), (1, [0]), (2, [1, 0])):
        one = [{"path": "p", "op": "Modify" if n else "Add", "blob_id": bytes(32), "mode": 33188, "status": rows[n]["status"]}]
        assert ids[n] == canon.atom_id([ids[p] for p in up], one, [], rows[n])
    assert [bytes(r["v"]) for r in spark.createDataFrame([(0,), (127,), (128,), (300,), (1 << 30,)], "n bigint").select(canon.varint_column(F.col("n")).alias("v")).collect()] == [canon.uvarint(n) for n in (0, 127, 128, 300, 1 << 30)]


def test_mutated_inputs_end_in_typed_errors():
    rng = np.random.default_rng(5)
    seeds = [(RCS, lambda d: rcs.contents(rcs.parse(d)), (rcs.Malformed, UnicodeDecodeError)), (make_revlog([b"one", b"one two", b"xyz"])[0], lambda d: list(revlog.texts(d)), (revlog.Malformed, struct.error))]
    for seed, parse, errors in seeds:
        for _ in range(300):
            data = bytearray(seed)
            for _ in range(rng.integers(1, 4)):
                k = int(rng.integers(len(data)))
                data[k : k + int(rng.integers(0, 3))] = rng.bytes(int(rng.integers(0, 3)))
            try:
                parse(bytes(data[: int(rng.integers(1, len(data) + 1))]) if rng.random() < 0.3 else bytes(data))
            except errors:
                pass


def checked(history):
    from annalspark.operators import verify

    state, rows = verify.verdict(history)
    assert state == "pass", [r for r in verify.violations(history).collect()]
    return {r["atom_idx"]: r for r in history.atoms.collect()}, {(r["path"], r["op"]) for r in history.ops.collect()}


def test_decode_cvs(spark, tmp_path):
    from annalspark.sources.decode import decode

    (tmp_path / "mod").mkdir()
    (tmp_path / "mod/a.c,v").write_bytes(RCS)
    (tmp_path / "mod/b.c,v").write_bytes(RCS)
    h = decode(spark, "cvs", str(tmp_path))
    atoms, ops = checked(h)
    assert [bytes(atoms[i]["message"]["bytes"]) for i in (0, 1)] == [b"first\n", b"second @ time\n"]
    assert ops == {("mod/a.c", "Add"), ("mod/b.c", "Add"), ("mod/a.c", "Modify"), ("mod/b.c", "Modify"), ("mod/a.c", "Delete"), ("mod/b.c", "Delete")}
    # the branch leaves the main line at the first changeset, and its only changeset deletes both files
    place = {bytes(r["atom_id"]): r["atom_idx"] for r in h.atoms.collect()}
    assert {(r["name"], r["kind"], place[bytes(r["target"])]) for r in h.refs.collect()} == {("REL", "tag", 0), ("BR", "branch", 2)}
    assert {(place[bytes(r["atom_id"])], place[bytes(r["parent_id"])]) for r in h.parents.collect()} == {(1, 0), (2, 0)}
    assert bytes(atoms[2]["message"]["bytes"]) == b"branch\n" and h.blobs.count() == 2 and h.drops.count() == 0


def test_decode_cvs_branches(spark, tmp_path):
    from annalspark.sources.decode import decode

    def rcs_file(revs, symbols):
        """revs: (number, day, log, text); the trunk's texts are stored backwards, a branch's forwards, whole lines each."""
        trunk = [r for r in revs if r[0].count(".") == 1][::-1]
        side = [r for r in revs if r[0].count(".") > 1]
        child = {r[0]: [s[0] for s in side if s[0].rsplit(".", 2)[0] == r[0] and s[0].endswith(".1")] for r in revs}
        head = f"head\t{trunk[0][0]};\naccess;\nsymbols{''.join(f' {n}:{v}' for n, v in symbols)};\nlocks; strict;\n\n"
        nxt = {a[0]: b[0] for a, b in zip(trunk, trunk[1:], strict=False)} | {a[0]: b[0] for a, b in zip(side, side[1:], strict=False) if a[0].rsplit(".", 1)[0] == b[0].rsplit(".", 1)[0]}
        body = "".join(f"{v}\ndate\t2024.01.{d:02}.00.00.00;\tauthor al;\tstate Exp;\nbranches {' '.join(child[v])};\nnext\t{nxt.get(v, '')};\n\n" for v, d, *_ in trunk + side)
        texts = "".join(f"\n{v}\nlog\n@{log}@\ntext\n@{text if v == trunk[0][0] else 'd1 1' + chr(10) + 'a1 1' + chr(10) + text}@\n" for v, _, log, text in trunk + side)
        return (head + "\n" + body + "\ndesc\n@@\n" + texts).encode()

    # b leaves a's trunk at 1.2 and c's at 1.1; x leaves b where both files have a revision on it; c's 1.2 comes before a's 1.2
    a = rcs_file([("1.1", 1, "one", "a1\n"), ("1.2", 3, "three", "a2\n"), ("1.2.2.1", 5, "on b", "a3\n"), ("1.2.2.1.2.1", 7, "on x", "a4\n")], [("b", "1.2.0.2"), ("x", "1.2.2.1.0.2")])
    c = rcs_file([("1.1", 1, "one", "c1\n"), ("1.2", 2, "two", "c2\n"), ("1.1.2.1", 5, "on b", "c3\n")], [("b", "1.1.0.2"), ("x", "1.1.2.1.0.2")])
    (tmp_path / "a,v").write_bytes(a)
    (tmp_path / "c,v").write_bytes(c)
    h = decode(spark, "cvs", str(tmp_path))
    atoms, _ = checked(h)
    name = {bytes(r["atom_id"]): bytes(r["message"]["bytes"]).decode() if r["message"] else "point" for r in h.atoms.collect()}
    up = {name[bytes(r["atom_id"])]: name[bytes(r["parent_id"])] for r in h.parents.collect()}
    assert up == {"two": "one", "three": "two", "point": up["point"], "on b": "point", "on x": "on b"}
    changes = {(name[bytes(r["atom_id"])], r["path"], r["op"]) for r in h.ops.collect()}
    # one file is at its point from the first changeset until the second, the other from the third on: the cut covers one
    want = {"one": {("point", "a", "Modify")}, "three": {("point", "c", "Modify")}}[up["point"]]
    assert {c for c in changes if c[0] in ("point", "on b", "on x")} == want | {("on b", "a", "Modify"), ("on b", "c", "Modify"), ("on x", "a", "Modify")}
    point = h.atoms.filter("message is null").first()["status"]["derivation"]
    assert (point["kind"], point["confidence"]) == ("reconstructed-branch", 50)
    assert {(r["name"], name[bytes(r["target"])]) for r in h.refs.collect()} == {("b", "on b"), ("x", "on x")} and h.drops.count() == 0


def test_decode_svn(spark, tmp_path):
    from annalspark.sources.decode import decode

    def rev(n, log):
        p = props((b"svn:date", b"2024-02-02T00:00:00.000000Z"), (b"svn:log", log))
        return b"Revision-number: %d\nProp-content-length: %d\nContent-length: %d\n\n%s\n" % (n, len(p), len(p), p)

    folder = lambda path, **h: node(path, "add", **h).replace(b"Node-kind: file", b"Node-kind: dir")
    stream = b"SVN-fs-dump-format-version: 2\n\n" + rev(0, b"") + rev(1, b"one") + folder("trunk") + node("trunk/a", "add", b"1") + node("trunk/d/b", "add", b"2")
    stream += rev(2, b"two") + folder("tags/v", **{"Node-copyfrom-rev": "1", "Node-copyfrom-path": "trunk"}) + node("trunk/a", "change", b"3")
    stream += rev(3, b"three") + node("trunk/d", "delete") + node("trunk/a", "replace", b"3") + node("readme", "add", b"x")
    (tmp_path / "d.dump").write_bytes(stream)
    h = decode(spark, "svn", str(tmp_path / "d.dump"))
    atoms, ops = checked(h)
    assert len(atoms) == 3 and ops == {("trunk/a", "Add"), ("trunk/d/b", "Add"), ("tags/v/a", "Add"), ("tags/v/d/b", "Add"), ("trunk/a", "Modify"), ("trunk/a", "Replace"), ("trunk/d/b", "Delete"), ("readme", "Add")}
    assert {(r["name"], r["kind"]) for r in h.refs.collect()} == {("trunk", "branch"), ("tags/v", "tag")}
    assert {(r["from"], r["to"]) for r in h.copies.collect()} == {("trunk/a", "tags/v/a"), ("trunk/d/b", "tags/v/d/b")} and h.drops.count() == 1

    def tail(key):
        p = props((key, b"x"))
        return rev(4, b"four") + b"Node-path: trunk/p\nNode-kind: file\nNode-action: add\nProp-content-length: %d\nText-content-length: 1\nContent-length: %d\n\n" % (len(p), len(p) + 1) + p + b"5\n\n"

    (tmp_path / "e.dump").write_bytes(stream + tail(b"svn:ignore"))
    assert {(r["class"], r["what"]) for r in decode(spark, "svn", str(tmp_path / "e.dump")).drops.collect()} == {("layout", "paths outside the layout"), ("properties", "workflow properties")}
    (tmp_path / "f.dump").write_bytes(stream + tail(b"svn:externals"))
    with pytest.raises(svndump.Malformed, match="externals"):
        decode(spark, "svn", str(tmp_path / "f.dump"))


def test_decode_git(spark, tmp_path):
    from annalspark.sources.decode import decode

    def put(kind, content):
        oid = gitstore.object_id(kind, content)
        (tmp_path / "objects" / oid.hex()[:2]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "objects" / oid.hex()[:2] / oid.hex()[2:]).write_bytes(zlib.compress(f"{kind} {len(content)}\0".encode() + content))
        return oid

    def commit(tree, *parents, message=b"m"):
        return put("commit", b"tree " + tree.hex().encode() + b"".join(b"\nparent " + p.hex().encode() for p in parents) + b"\nauthor A <a@x> 5 +0100\ncommitter C <c@x> 6 -0030\n\n" + message)

    one, two = put("blob", b"1"), put("blob", b"2")
    t1, t2 = put("tree", b"100644 a\0" + one), put("tree", b"100644 b\0" + one + b"100644 c\0" + two)
    c1 = commit(t1, message=b"root")
    c2, c3 = commit(t2, c1, message=b"move"), commit(t1, c1, message=b"side")
    c4 = commit(t2, c2, c3, message=b"merge")
    lost = commit(t1, message=b"stash")
    for name, oid in (("heads/main", c4), ("tags/v1", c1), ("stash", lost)):
        (tmp_path / "refs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "refs" / name).write_text(oid.hex() + "\n")
    h = decode(spark, "git", str(tmp_path), infer_renames=True)
    atoms, ops = checked(h)
    assert [bytes(atoms[0]["message"]["bytes"]), bytes(atoms[3]["message"]["bytes"])] == [b"root", b"merge"] and h.parents.count() == 4
    assert ops == {("a", "Add"), ("a", "Delete"), ("b", "Add"), ("c", "Add")}
    assert [(r["from"], r["to"], r["status"]["derivation"]["kind"]) for r in h.copies.collect()] == [("a", "b", "inferred-rename")]
    assert {(r["name"], r["kind"]) for r in h.refs.collect()} == {("refs/heads/main", "branch"), ("refs/tags/v1", "tag")} and h.blobs.count() == 2
    assert {(r["class"], r["reason"]) for r in h.drops.collect()} == {("namespace", "1 references are not carried"), ("commits", "1 commits are not carried")}
    # a move: from the first parent, and the commit deletes the source
    from annalspark.operators import diff, verify

    assert [(r["from"], r["to"]) for r in diff.moves(h.copies, h.ops, h.parents).collect()] == [("a", "b")]
    # another version stamps other ids on what it derives and on what descends from that; stamped alike, they are the same
    later = verify.restamped(h, "9.9", "9.9")
    ids = lambda x: {bytes(r[0]) for r in x.atoms.select("atom_id").collect()}
    assert verify.verdict(later)[0] == "pass" and len(ids(later) - ids(h)) == 2
    assert verify.rederived(h, later).count() == 0 and verify.rederived(h, later.replace(atoms=later.atoms, ops=later.ops.filter("path <> 'c'"))).count() > 0
    (tmp_path / "shallow").write_text(c1.hex() + "\n")
    with pytest.raises(gitstore.Malformed, match="shallow"):
        decode(spark, "git", str(tmp_path))


def test_decode_hg(spark, tmp_path):
    from annalspark.sources.decode import decode

    files = make_revlog([b"hello", b"hello again"])
    n = [x.hex().encode() for x in files[2]]
    trees = make_revlog([b"a.txt\0" + n[0] + b"\n", b"a.txt\0" + n[1] + b"\n", b"a.txt\0" + n[1] + b"x\n"])
    logs = make_revlog([trees[2][i].hex().encode() + b"\nAl <al@x>\n100%d 0\na.txt\n\nc%d" % (i, i) for i in range(3)])
    (tmp_path / "data").mkdir()
    for name, r in (("00changelog", logs), ("00manifest", trees), ("data/a.txt", files)):
        (tmp_path / f"{name}.i").write_bytes(r[0])
    (tmp_path / "phaseroots").write_bytes(b"2 " + logs[2][2].hex().encode() + b"\n")
    (tmp_path / "obsstore").write_bytes(b"\1")
    (tmp_path / "bookmarks").write_bytes(logs[2][0].hex().encode() + b" mark\n")
    h = decode(spark, "hg", str(tmp_path))
    atoms, ops = checked(h)
    assert len(atoms) == 2 and ops == {("a.txt", "Add"), ("a.txt", "Modify")} and h.drops.count() == 1
    assert {(r["name"], r["kind"]) for r in h.refs.collect()} == {("default", "named-branch"), ("mark", "bookmark")}
    (tmp_path / "requires").write_text("revlogv1\nlargefiles\n")
    with pytest.raises(revlog.Malformed, match="largefiles"):
        decode(spark, "hg", str(tmp_path))


def test_decode_hg_copies(spark, tmp_path):
    from annalspark.sources.decode import decode

    a = make_revlog([b"hello"])
    b = make_revlog([b"\1\ncopy: a\ncopyrev: " + a[2][0].hex().encode() + b"\n\1\nhello"])
    trees = make_revlog([b"a\0" + a[2][0].hex().encode() + b"\n", b"", b"b\0" + b[2][0].hex().encode() + b"\n"])
    # the first parent no longer holds the source: the changeset that brought it is the copy's source
    logs = make_revlog([trees[2][i].hex().encode() + b"\nAl <al@x>\n100%d 0\na\n\nc%d" % (i, i) for i in range(3)])
    (tmp_path / "data").mkdir()
    for name, r in (("00changelog", logs), ("00manifest", trees), ("data/a", a), ("data/b", b)):
        (tmp_path / f"{name}.i").write_bytes(r[0])
    for name in ("phaseroots", "bookmarks"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "obsstore").write_bytes(b"\1")
    h = decode(spark, "hg", str(tmp_path))
    place = {bytes(r["atom_id"]): r["atom_idx"] for r in h.atoms.collect()}
    assert [(r["from"], place[bytes(r["from_atom"])], r["to"], place[bytes(r["atom_id"])]) for r in h.copies.collect()] == [("a", 0, "b", 2)]
