"""Subversion dump streams (versions 1 to 3): records of a stream are cut apart in one task, as they are length-prefixed.

Tables: revisions (number, props) and nodes (revision, ord, path, kind, action, copyfrom_rev, copyfrom_path, props,
text, md5, sha1, is_delta).  `raw` gives texts as the stream has them; `read` gives them in full, where deltas (svndiff
0) are applied to what lived at the path, or at the copy's source (`svntree`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

MAX_TEXT = 1 << 30
ROWS = "kind string, number bigint, ord bigint, path string, node_kind string, action string, copyfrom_rev bigint, copyfrom_path string, props array<struct<k:string,v:binary>>, text binary, md5 string, sha1 string, is_delta boolean"


class Malformed(ValueError):
    """A stream that is not what its format says."""


def _size(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    for k in range(10):
        if at >= len(data):
            raise Malformed("a number does not end")
        n, at = n << 7 | data[at] & 127, at + 1
        if data[at - 1] < 128:
            return n, at
    raise Malformed("a number is too long")


def svndiff(delta: bytes, base: bytes, limit: int = MAX_TEXT) -> bytes:
    """The target of a version-0 delta."""
    if delta[:3] != b"SVN" or len(delta) < 4 or delta[3] != 0:
        raise Malformed("not a delta of version 0")
    out, at = bytearray(), 4
    while at < len(delta):
        head = []
        for _ in range(5):
            n, at = _size(delta, at)
            head.append(n)
        offset, length, target, n_ops, n_new = head
        if offset + length > len(base):
            raise Malformed("a source view outside the base")
        if len(out) + target > limit:
            raise Malformed("the target is larger than the ceiling")
        if at + n_ops + n_new > len(delta):
            raise Malformed("a window does not end")
        view, ops, new = base[offset : offset + length], delta[at : at + n_ops], delta[at + n_ops : at + n_ops + n_new]
        at += n_ops + n_new
        start, used, i = len(out), 0, 0
        while i < len(ops):
            op, size = ops[i] >> 6, ops[i] & 63
            i += 1
            if not size:
                size, i = _size(ops, i)
            made = len(out) - start
            if made + size > target:
                raise Malformed("the instructions run past the target")
            if op == 2:
                if used + size > len(new):
                    raise Malformed("not enough new data")
                out += new[used : used + size]
                used += size
                continue
            if op > 2:
                raise Malformed("an unknown instruction")
            where, i = _size(ops, i)
            if op == 0:
                if where + size > len(view):
                    raise Malformed("a copy outside the source view")
                out += view[where : where + size]
            else:
                if where >= made:
                    raise Malformed("a copy from behind the target's end")
                while size:  # the copy may overlap what it writes
                    piece = out[start + where : start + where + size]
                    out += piece
                    where, size = where + len(piece), size - len(piece)
        if len(out) - start != target or used != n_new:
            raise Malformed("the window does not fill its target")
    return bytes(out)


def properties(block: bytes) -> tuple[list[tuple[str, bytes]], list[str]]:
    """Set and deleted properties of a K/V block."""
    out, gone, at = [], [], 0

    def line() -> bytes:
        nonlocal at
        end = block.find(b"\n", at)
        if end < 0:
            raise Malformed("a property line does not end")
        found, at = block[at:end], end + 1
        return found

    def value(head: bytes) -> bytes:
        nonlocal at
        n = int(head[2:])
        if at + n > len(block):
            raise Malformed("a property does not end")
        found = block[at : at + n]
        at += n + 1
        return found

    while at < len(block):
        head = line()
        if head == b"PROPS-END":
            break
        if head[:2] == b"K ":
            key = value(head).decode()
            out.append((key, value(line())))
        elif head[:2] == b"D ":
            gone.append(value(head).decode())
        else:
            raise Malformed("an unknown property line")
    return out, gone


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, property block, text block) of every record."""
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n\n", at)
        if end < 0:
            if data[at:].strip():
                raise Malformed("headers do not end")
            return
        head = {}
        for row in data[at:end].split(b"\n"):
            k, sep, v = row.partition(b": ")
            if not sep:
                raise Malformed(f"not a header: {row[:40]!r}")
            head[k.decode()] = v.decode()
        at = end + 2
        n_props, n_text = int(head.get("Prop-content-length", 0)), int(head.get("Text-content-length", 0))
        if at + n_props + n_text > len(data):
            raise Malformed("a record does not end")
        yield head, data[at : at + n_props], data[at + n_props : at + n_props + n_text]
        at += max(n_props + n_text, int(head.get("Content-length", 0)))


def rows_of(data: bytes) -> Iterator[tuple]:
    """Rows of one stream, texts as they are in it."""
    number, ord_ = -1, 0
    for head, prop_block, text in records(data):
        if "SVN-fs-dump-format-version" in head:
            if head["SVN-fs-dump-format-version"] not in ("1", "2", "3"):
                raise Malformed("an unknown stream version")
        elif "Revision-number" in head:
            number, ord_ = int(head["Revision-number"]), 0
            yield ("rev", number, 0, None, None, None, None, None, properties(prop_block)[0], None, None, None, False)
        elif "Node-path" in head:
            source_rev = int(head["Node-copyfrom-rev"]) if "Node-copyfrom-rev" in head else None
            body = text if "Text-content-length" in head else None
            is_delta = body is not None and head.get("Text-delta") == "true"
            yield ("node", number, ord_, head["Node-path"], head.get("Node-kind"), head["Node-action"], source_rev, head.get("Node-copyfrom-path"), properties(prop_block)[0], body, head.get("Text-content-md5"), head.get("Text-content-sha1"), is_delta)
            ord_ += 1


def raw(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in ROWS.replace("array<struct<k:string,v:binary>>", "x").split(", ")]
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for r in rows_of(bytes(data)):
                    rows.append((*r[:8], [{"k": k, "v": v} for k, v in r[8]], *r[9:]))
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    rows = written(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ROWS), "svn-stream")
    return {
        "revisions": rows.filter("kind = 'rev'").select("number", "props"),
        "nodes": rows.filter("kind = 'node'").selectExpr("number as revision", "ord", "path", "node_kind as kind", "action", "copyfrom_rev", "copyfrom_path", "props", "text", "md5", "sha1", "is_delta"),
    }


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from . import svntree

    tables = raw(spark, path)
    full = svntree.texts(tables["nodes"], written(svntree.lives(tables["nodes"]), "svn-lives")).select("event", F.col("text").alias("full"))
    event = F.shiftleft(F.col("revision"), 24) + F.col("ord")
    nodes = tables["nodes"].withColumn("event", event).join(full, "event", "left")
    stated = F.col("text").isNotNull() | F.col("copyfrom_path").isNotNull()
    return tables | {"nodes": nodes.withColumn("text", F.when(stated, F.col("full"))).drop("full", "event", "is_delta")}
