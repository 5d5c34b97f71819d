"""Git object stores: loose objects and packs, references, commits, trees and tags.

Tables: objects (oid, kind, content), commits, tree_entries (tree, name, oid, mode), tags and refs (name, oid, symbolic).
A loose object is a row.  Packs with an index are read in ranges by many tasks (`packs`); a pack without one is one row and
task, of 2 GB at most.  Every object is hashed again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Rounds
from . import packs
from .gitobjects import KINDS, Malformed, apply_delta, entry_head, loose, object_id

def check_layout(names: set[str], config: str) -> None:
    """Refuses stores whose history is not all there or not what it seems."""
    for name, why in (("shallow", "a shallow clone"), ("info/grafts", "grafted parents"), ("objects/info/alternates", "objects kept elsewhere")):
        if name in names:
            raise Malformed(f"{why} is not read")
    if "objectformat" in config.lower() and "sha256" in config.lower():
        raise Malformed("a SHA-256 store is not read")
    if "partialclone" in config.lower():
        raise Malformed("a partial clone is not read")


def pack(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(kind, content) of every object of a pack whose deltas have their bases in it."""
    if data[:4] != b"PACK" or int.from_bytes(data[4:8]) not in (2, 3) or hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise Malformed("not a whole pack")
    count, at = int.from_bytes(data[8:12]), 12
    done: dict[int, tuple[str, bytes]] = {}
    by_id: dict[bytes, int] = {}
    waiting: list[tuple[int, object, bytes]] = []
    body = memoryview(data)[:-20]
    for _ in range(count):
        start = at
        kind, size, base, at = entry_head(data, start, start)
        d = zlib.decompressobj()
        content = d.decompress(body[at:], size + 1)
        if len(content) != size:
            raise Malformed("an object has another size than it says")
        if not d.eof:
            d.decompress(d.unconsumed_tail or b"", 1)
        at = len(body) - len(d.unused_data)
        if kind in KINDS:
            done[start] = (KINDS[kind], content)
            by_id[object_id(KINDS[kind], content)] = start
        else:
            waiting.append((start, base, content))
    while waiting:
        left = []
        for start, base, delta in waiting:
            where = by_id.get(base) if isinstance(base, bytes) else base
            if where in done:
                kind_name, text = done[where]
                made = apply_delta(text, delta)
                done[start] = (kind_name, made)
                by_id[object_id(kind_name, made)] = start
            else:
                left.append((start, base, delta))
        if len(left) == len(waiting):
            raise Malformed("a delta without its base")
        waiting = left
    yield from done.values()


def headers(body: bytes) -> tuple[list[tuple[str, bytes]], bytes]:
    """Header fields in order (continued lines joined) and the message."""
    head, _, message = body.partition(b"\n\n")
    out: list[tuple[str, bytes]] = []
    for row in head.split(b"\n"):
        if row[:1] == b" " and out:
            out[-1] = (out[-1][0], out[-1][1] + b"\n" + row[1:])
        else:
            k, _, v = row.partition(b" ")
            out.append((k.decode("latin1"), v))
    return out, message


def person(line: bytes) -> tuple[bytes, bytes, str, str]:
    """name, email, raw seconds and raw offset of an author or committer line."""
    end = line.rfind(b">")
    start = line.find(b"<")
    if start < 0 or end < start:
        raise Malformed("an identity without an address")
    when = line[end + 1 :].strip().split(b" ")
    return line[:start].rstrip(b" "), line[start + 1 : end], when[0].decode("latin1"), when[1].decode("latin1") if len(when) > 1 else ""


def tree(body: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(mode, name, oid) of a tree's entries."""
    at = 0
    while at < len(body):
        space, nul = body.find(b" ", at), body.find(b"\0", at)
        if space < 0 or nul < space or nul + 21 > len(body):
            raise Malformed("a tree entry does not end")
        yield int(body[at:space], 8), body[space + 1 : nul], body[nul + 1 : nul + 21]
        at = nul + 21


def read(spark: SparkSession, git_dir: str) -> dict[str, DataFrame]:
    """Tables of a bare store or a .git folder."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                if path.endswith(".pack"):
                    rows = [(object_id(k, c), k, c) for k, c in pack(bytes(data))]
                else:
                    kind, content = loose(bytes(data))
                    oid = object_id(kind, content)
                    if oid.hex() != "".join(path.rsplit("/", 2)[-2:]):
                        raise Malformed("an object does not hash to its name")
                    rows = [(oid, kind, content)]
                yield pd.DataFrame(rows, columns=["oid", "kind", "content"])

    def of(glob: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(git_dir).select("path", "length", "content")

    marks = of("{config,shallow,grafts,alternates}").filter(F.col("path").rlike("/(config|shallow|info/grafts|objects/info/alternates)$")).select(F.regexp_extract("path", "/(config|shallow|info/grafts|objects/info/alternates)$", 1).alias("name"), F.decode("content", "UTF-8").alias("text")).collect()  # four files
    check_layout({r["name"] for r in marks if r["text"].strip()}, "\n".join(r["text"] for r in marks if r["name"] == "config"))
    singles = of("[0-9a-f]" * 38).filter(F.col("path").rlike("/objects/[0-9a-f]{2}/[0-9a-f]{38}$"))
    indexes = of("*.idx").filter(F.col("path").rlike(r"/objects/pack/pack-[0-9a-f]+\.idx$"))
    whole = of("*.pack").filter(F.col("path").rlike(r"/objects/pack/pack-[0-9a-f]+\.pack$"))
    stems = {r[0].removesuffix(".idx") for r in indexes.select("path").collect()}  # names of files, as Spark lists them anyway
    sizes = {r["path"]: r["length"] for r in whole.select("path", "length").collect()}
    bare = [p for p in sizes if p.removesuffix(".pack") not in stems]
    if any(sizes[p] >= 1 << 31 for p in bare):
        raise Malformed("a pack of 2 GB or more needs its index")
    if stems - {p.removesuffix(".pack") for p in sizes}:
        raise Malformed("an index without its pack")
    objects = singles.select("path", "content").mapInPandas(run, "oid binary, kind string, content binary")
    if stems:
        names = singles.select(F.unhex(F.regexp_replace(F.regexp_extract("path", "([0-9a-f]{2}/[0-9a-f]{38})$", 1), "/", "")).alias("oid"), "path")
        objects = objects.unionAll(packs.objects(spark, indexes, [p for p in sizes if p not in bare], names))
    if bare:
        one_by_one = spark.read.format("binaryFile").load(bare).select("path", "content")
        objects = objects.unionAll(one_by_one.mapInPandas(run, "oid binary, kind string, content binary")).dropDuplicates(["oid"])

    def commit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for oid, body in zip(pdf["oid"], pdf["content"], strict=True):
                head, message = headers(bytes(body))
                one = dict(reversed(head))
                a, c = person(one["author"]), person(one["committer"])
                rows.append((bytes(oid), bytes.fromhex(one["tree"].decode()), [bytes.fromhex(v.decode()) for k, v in head if k == "parent"], *a, *c, one["encoding"].decode("latin1") if "encoding" in one else None, message, [{"k": k, "v": v} for k, v in head if k not in ("tree", "parent", "author", "committer", "encoding")]))
            yield pd.DataFrame(rows, columns=["oid", "tree", "parents", "author_name", "author_email", "author_seconds", "author_offset", "committer_name", "committer_email", "commit_seconds", "commit_offset", "encoding", "message", "extra"])

    def tree_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(bytes(oid), name, child, mode) for oid, body in zip(pdf["oid"], pdf["content"], strict=True) for mode, name, child in tree(bytes(body))], columns=["tree", "name", "oid", "mode"])

    def tag_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for oid, body in zip(pdf["oid"], pdf["content"], strict=True):
                head, message = headers(bytes(body))
                one = dict(head)
                rows.append((bytes(oid), bytes.fromhex(one["object"].decode()), one["type"].decode(), one["tag"], message))
            yield pd.DataFrame(rows, columns=["oid", "target", "target_kind", "name", "message"])

    text = F.decode("content", "UTF-8")
    files = of("*").filter("length < 4096")  # the limit reaches the scan, so that no large file is opened
    single = files.filter(F.col("path").rlike(r"/(refs/.*|HEAD)$") & ~F.col("path").contains("/logs/")).select(F.regexp_extract("path", r"/(refs/.*|HEAD)$", 1).alias("name"), F.trim(F.regexp_replace(text, r"\s+$", "")).alias("value"), F.lit(1).alias("rank"))
    packed = of("packed-refs").select(F.explode(F.split(text, "\n")).alias("line")).filter(F.col("line").rlike("^[0-9a-f]{40} ")).select(F.substring("line", 42, 4096).alias("name"), F.substring("line", 1, 40).alias("value"), F.lit(2).alias("rank"))
    refs = single.unionAll(packed).groupBy("name").agg(F.min_by("value", "rank").alias("value"))
    refs = refs.select("name", F.when(F.col("value").rlike("^[0-9a-f]{40}$"), F.unhex("value")).alias("oid"), F.when(F.startswith("value", F.lit("ref: ")), F.substring("value", 6, 4096)).alias("symbolic"))
    return {
        "objects": objects,
        "commits": objects.filter("kind = 'commit'").mapInPandas(commit_rows, "oid binary, tree binary, parents array<binary>, author_name binary, author_email binary, author_seconds string, author_offset string, committer_name binary, committer_email binary, commit_seconds string, commit_offset string, encoding string, message binary, extra array<struct<k:string,v:binary>>"),
        "tree_entries": objects.filter("kind = 'tree'").mapInPandas(tree_rows, "tree binary, name binary, oid binary, mode int"),
        "tags": objects.filter("kind = 'tag'").mapInPandas(tag_rows, "oid binary, target binary, target_kind string, name binary, message binary"),
        "refs": refs,
    }


def ref_kind(name: Column) -> Column:
    """branch, tag or null (a namespace that is dropped and counted)."""
    return F.when(F.startswith(name, F.lit("refs/heads/")), "branch").when(F.startswith(name, F.lit("refs/tags/")), "tag")


def peeled(refs: DataFrame, tags: DataFrame, hops: int = 32) -> DataFrame:
    """refs with the object at the end of their tag chains and the number of tags passed; too long a chain is refused."""
    rounds = Rounds(refs.sparkSession, "peeled")
    now = rounds.write(refs.filter("oid is not null").select("name", F.col("oid").alias("target"), F.lit(0).alias("hops")))
    above = tags.select(F.col("oid").alias("_tag"), F.col("target").alias("_next"))
    for k in range(hops):
        met = now.join(above, F.col("target") == F.col("_tag"), "left")
        if met.filter("_tag is not null").isEmpty():
            break
        now = rounds.write(met.select("name", F.coalesce("_next", "target").alias("target"), F.when(F.col("_tag").isNull(), F.col("hops")).otherwise(k + 1).alias("hops")))
        rounds.keep_last(1)
    return now


def snapshot(tree_entries: DataFrame, roots: DataFrame, depth: int = 256) -> DataFrame:
    """root, path, oid, mode of every file below each root tree; submodule links are refused."""
    names = tree_entries.withColumn("name", F.decode("name", "UTF-8"))
    if not names.filter(F.col("mode") == 0o160000).limit(1).isEmpty():
        raise Malformed("submodule links are not read")
    rounds = Rounds(roots.sparkSession, "trees")
    entries = names.select("tree", "name", "oid", "mode")
    now = rounds.write(roots.select("root").distinct().join(entries, F.col("root") == F.col("tree")).select("root", F.col("name").alias("path"), "oid", "mode"))
    files = now.filter("mode <> 16384")
    for _ in range(depth):  # a round per level of folders
        below = entries.select(F.col("tree").alias("oid"), "name", F.col("oid").alias("next"), F.col("mode").alias("kind"))
        now = rounds.write(now.filter("mode = 16384").join(below, "oid").select("root", F.concat_ws("/", "path", "name").alias("path"), F.col("next").alias("oid"), F.col("kind").alias("mode")))
        if now.isEmpty():
            return files
        files = files.unionAll(now.filter("mode <> 16384"))
    raise Malformed("folders are nested too deep")
