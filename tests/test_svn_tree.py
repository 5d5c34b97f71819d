"""Subversion trees as lives of paths, against a fold of the stream."""

import hashlib
import random

import pytest

from annalspark.sources import svndump, svntree
from annalspark.storage import written

NODES = "revision long, ord long, path string, kind string, action string, copyfrom_rev long, copyfrom_path string, props array<struct<k:string,v:binary>>, text binary, md5 string, sha1 string, is_delta boolean"


def _fold(rows):
    """(revision, path, op, text, executable, from, from revision) of records in order, the whole tree kept for every revision."""
    tree, kept, out = {}, {0: {}}, []
    for number in sorted({r[0] for r in rows}):
        start, fresh, copied = dict(tree), set(), {}
        for _, _, path, kind, action, rev, source, props, text, *_ in sorted((r for r in rows if r[0] == number), key=lambda r: r[1]):
            if action in ("delete", "replace"):
                for p in [p for p in tree if p == path or p.startswith(path + "/")]:
                    del tree[p]
                if action == "delete":
                    continue
            state = kept[max(k for k in kept if k <= rev)] if source else {}
            if kind == "file":
                old = tree.get(path) or start.get(path)
                if action in ("add", "replace"):
                    fresh.add(path)
                if source:
                    old, copied[path] = state[source], (source, rev)
                names = [p["k"] for p in props]
                tree[path] = (text if text is not None else old[0] if old else b"", "svn:executable" in names if names or not old else old[1])
            elif source:
                for p in [p for p in state if p.startswith(source + "/")]:
                    to = path + p[len(source) :]
                    tree[to], copied[to] = state[p], (p, rev)
                    fresh.add(to)
        for path in start.keys() | tree.keys():
            a, b = start.get(path), tree.get(path)
            op = "Add" if a is None else "Delete" if b is None else "Replace" if path in fresh else "Modify" if a != b else None
            if op:
                out.append((number, path, op, *(b or (None, None)), *(copied.get(path, (None, None)) if b else (None, None))))
        kept[number] = dict(tree)
    return sorted(out, key=str)


def _lived(spark, rows):
    nodes = spark.createDataFrame(rows, NODES)
    lived = written(svntree.lives(nodes), "test-lives")
    known = svntree.texts(nodes, lived).selectExpr("event", "text", "executable", "struct(sha2(text, 256), executable, special) as state")
    known = written(known, "test-texts")
    found = svntree.changes(lived, known).join(known.drop("state"), "event", "left").select("revision", "path", "op", "text", "executable", "from", "from_revision")
    return sorted(((*r[:3], None if r[3] is None else bytes(r[3]), *r[4:]) for r in found.collect()), key=str)


def _row(revision, ord_, path, kind, action, text=None, rev=None, source=None, executable=None):
    props = [] if executable is None else [{"k": "svn:executable" if executable else "other", "v": b"*"}]
    digest = None if text is None else hashlib.md5(text).hexdigest()
    return (revision, ord_, path, kind, action, rev, source, props, text, digest, None, False)


def _stream(rng, revisions):
    """A valid stream: files change and go, folders are copied, copied again, replaced and deleted, files leave copied folders."""
    rows, tree, kept, made = [], {"trunk/f0": 1, "trunk/d/f1": 1}, {}, 0
    rows += [_row(1, 0, "trunk/f0", "file", "add", b"0"), _row(1, 1, "trunk/d/f1", "file", "add", b"1")]
    kept[1] = set(tree)
    for n in range(2, revisions):
        live, touched = set(kept[n - 1]), set()
        for k in range(rng.randrange(1, 4)):
            free = sorted(p for p in live if not any(p == t or p.startswith(t + "/") or t.startswith(p + "/") for t in touched))
            kind = rng.random()
            if kind < 0.35 and free:
                path = rng.choice(free)
                rows.append(_row(n, k, path, "file", rng.choice(["change", "replace"]), rng.choice([b"%d" % rng.randrange(5), b"same"]), executable=rng.choice([None, True, False])))
            elif kind < 0.45 and free:
                path = rng.choice(free)
                rows.append(_row(n, k, path, "file", "change", executable=rng.random() < 0.5))
            elif kind < 0.6:
                made += 1
                path = rng.choice(["trunk", "trunk/d", "tags/t1/d", "b"]) + f"/n{made}"
                rows.append(_row(n, k, path, "file", "add", b"n%d" % made))
                live.add(path)
            elif kind < 0.7 and free:
                path = rng.choice(free)
                path = rng.choice([path, path.rsplit("/", 1)[0]])
                if any(t.startswith(path + "/") or t == path for t in touched):
                    continue
                rows.append(_row(n, k, path, None, "delete"))
                live = {p for p in live if p != path and not p.startswith(path + "/")}
            elif kind < 0.8:
                rev = rng.randrange(max(1, n - 6), n)
                source = rng.choice(sorted(kept[rev]) or [None])
                if source is None:
                    continue
                made += 1
                path = f"b/c{made}"
                rows.append(_row(n, k, path, "file", "add", None if rng.random() < 0.7 else b"edited", rev, source))
                live.add(path)
            else:
                rev = rng.randrange(max(1, n - 6), n)
                source = rng.choice(sorted({p[: i] for p in kept[rev] for i in range(len(p)) if p[i] == "/"}) or [None])
                if source is None:
                    continue
                made += 1
                path = rng.choice([f"tags/t{made}", f"trunk/d/k{made}", "tags/t1"])
                there = any(p.startswith(path + "/") for p in live)
                if any(t.startswith(path) or path.startswith(t + "/") for t in touched):
                    continue
                rows.append(_row(n, k, path, "dir", "replace" if there else "add", None, rev, source))
                live = {p for p in live if not p.startswith(path + "/")} | {path + p[len(source) :] for p in kept[rev] if p.startswith(source + "/")}
            touched.add(path)
        kept[n] = live
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_lives_equal_a_fold(spark, seed):
    rows = _stream(random.Random(seed), 60)
    assert sum(r[3] == "dir" for r in rows) > 8
    assert _lived(spark, rows) == _fold(rows)


def test_a_file_leaves_a_folder_that_came_by_a_copy(spark):
    rows = [
        _row(1, 0, "trunk/f", "file", "add", b"one", executable=True),
        _row(2, 0, "branches/b", "dir", "add", None, 1, "trunk"),
        _row(3, 0, "trunk/g", "file", "add", None, 2, "branches/b/f"),
        _row(4, 0, "tags/t", "dir", "add", None, 3, "branches/b"),
        _row(4, 1, "tags/t/f", "file", "change", b"two"),
    ]
    found = _lived(spark, rows)
    assert found == _fold(rows)
    assert (3, "trunk/g", "Add", b"one", True, "branches/b/f", 2) in found and (4, "tags/t/f", "Add", b"two", True, "branches/b/f", 3) in found


def _number(n):
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def _delta(keep, new):
    """Keeps a number of bytes of the base and adds new ones."""
    ops = bytes([0]) + _number(keep) + _number(0) + bytes([2 << 6]) + _number(len(new))
    return b"SVN\0" + _number(0) + _number(keep) + _number(keep + len(new)) + _number(len(ops)) + _number(len(new)) + ops + new


def test_deltas_follow_copies_and_new_lives(spark):
    def row(revision, path, action, keep, new, want, rev=None, source=None):
        return (revision, 0, path, "file", action, rev, source, [], _delta(keep, new), None, hashlib.sha1(want).hexdigest(), True)

    rows = [
        row(1, "a/f", "add", 0, b"first", b"first"),
        row(2, "a/f", "change", 3, b"e", b"fire"),
        _row(3, 0, "b", "dir", "add", None, 1, "a"),
        row(4, "b/f", "change", 5, b"!", b"first!"),
        row(5, "c", "add", 4, b"?", b"fire?", 2, "a/f"),
        _row(6, 0, "a/f", None, "delete"),
        row(7, "a/f", "add", 0, b"again", b"again"),
    ]
    texts = {r[:3]: r[3] for r in _lived(spark, rows)}
    assert texts == {(1, "a/f", "Add"): b"first", (2, "a/f", "Modify"): b"fire", (3, "b/f", "Add"): b"first", (4, "b/f", "Modify"): b"first!", (5, "c", "Add"): b"fire?", (6, "a/f", "Delete"): None, (7, "a/f", "Add"): b"again"}
    wrong = [row(1, "f", "add", 0, b"x", b"y")]
    with pytest.raises(Exception, match="digest"):
        _lived(spark, wrong)
    with pytest.raises(Exception, match="no text of gone"):
        _lived(spark, [_row(2, 0, "f", "file", "add", None, 1, "gone")])


def test_the_stream_that_was_refused_decodes(spark, tmp_path):
    from annalspark.sources.decode import decode

    def record(path, kind, text=None, **heads):
        lines = "".join(f"{k.replace('_', '-')}: {v}\n" for k, v in {"Node-path": path, "Node-kind": kind, "Node-action": "add", **heads}.items())
        size = "" if text is None else f"Text-content-length: {len(text)}\nContent-length: {len(text)}\n"
        return (lines + size + "\n" + (text or "") + "\n\n").encode()

    copy = lambda rev, path: {"Node-copyfrom-rev": rev, "Node-copyfrom-path": path}
    stream = b"SVN-fs-dump-format-version: 2\n\nRevision-number: 1\n\n" + record("trunk/f", "file", "text")
    stream += b"Revision-number: 2\n\n" + record("branches/b", "dir", **copy(1, "trunk"))
    stream += b"Revision-number: 3\n\n" + record("trunk/g", "file", **copy(2, "branches/b/f"))
    (tmp_path / "s.dump").write_bytes(stream)
    assert [bytes(r["text"]) for r in svndump.read(spark, str(tmp_path / "s.dump"))["nodes"].filter("kind = 'file'").orderBy("revision").collect()] == [b"text", b"text"]
    h = decode(spark, "svn", str(tmp_path / "s.dump"))
    assert {(r["path"], r["op"]) for r in h.ops.collect()} == {("trunk/f", "Add"), ("branches/b/f", "Add"), ("trunk/g", "Add")}
    assert {(r["from"], r["to"]) for r in h.copies.collect()} == {("trunk/f", "branches/b/f"), ("branches/b/f", "trunk/g")}


def test_copied_lives_equal_all_pairs_and_are_not_paired_in_vain(spark):
    """Lives of any length, from one revision to all of them, against copies of their folders."""
    from annalspark.sources.svntree import _copied

    draw = random.Random(7)
    lived, copies = [], []
    for k in range(400):
        since = draw.randrange(200_000)
        till = draw.choice([None, since, since + 1, since + draw.randrange(1, 2000), since + draw.randrange(1, 300_000)])
        lived.append((f"t{k % 3}/s/f{k}", (since << 24) + k % 5, None if till is None else (till << 24) + 7, k))
    for k in range(150):
        copies.append((f"tags/{k}", (300_000 + k) << 24, draw.choice(["t0", "t1", "t1/s", "t", "t2/s/f2"]), draw.choice([0, 511, 512, 65_535, draw.randrange(250_000)])))
    found = _copied(spark.createDataFrame(lived, "path string, at long, until long, event long"), spark.createDataFrame(copies, "to string, copied_at long, _folder string, rev long"), max(c[3] for c in copies))
    want = [(to + path[len(folder):], at, event) for to, at, folder, rev in copies for path, since, until, event in lived if path.startswith(folder + "/") and since < (rev + 1) << 24 and (until is None or until >= (rev + 1) << 24)]
    assert sorted(map(tuple, found.select("path", "at", "event").collect())) == sorted(want) and want


def test_only_copies_that_are_touched_again_are_followed(spark):
    """A tag that nothing touches is not written and ended again; one that is changed, lost or copied on is."""
    from annalspark.sources.svntree import _open

    copies = spark.createDataFrame([("tags/a", 5 << 24, "trunk", 4), ("tags/b", 6 << 24, "trunk", 4), ("x/c", 7 << 24, "trunk", 4), ("y/d", 8 << 24, "tags/e", 4), ("tags/e", 9 << 24, "trunk", 4)], "to string, copied_at long, _folder string, rev long")
    marks = spark.createDataFrame([("tags/b/f", 10 << 24), ("tags/a/f", 4 << 24), ("x", 11 << 24)], "path string, at long")
    kills = marks.filter("path = 'x'")
    assert sorted(r["to"] for r in _open(copies, marks, kills).collect()) == ["tags/b", "tags/e", "x/c"]
