"""Packs of Git objects by their indexes: a pack of any size is read in byte ranges by many tasks.

An index gives every object's place, so no task reads a pack from its start.  Headers are read range by range and give
each delta its base: by place in its own pack, or by name in its own pack, another pack or a loose object, so that thin
packs are completed from the rest of the store.  The object at the end of each chain of bases is found by pointer
jumping.  A range of such ends, with all deltas above them, is then read by one task straight from the packs, so that
no content is shuffled; a walk in depth holds the contents of one chain at a time.

Every entry's checksum and every object's name are checked, and an index's own checksum; the digest at the end of a pack,
over all of it, is not.  Objects that stand in several places come once.
Deltas without a base, or in a circle, and indexes of version 1 are refused.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Rounds
from .artifact import place
from .gitobjects import KINDS, MAX_OBJECT, Malformed, apply_delta, entry_head, loose, object_id

MAGIC = b"\xfftOc\0\0\0\2"
#: Places in packs are numbers of this many bits; the number of the pack stands above them.
PLACE_BITS = 46
#: Bytes of a pack that one group of a task covers (a power of two), and bytes that are read or given on at once.
RANGE_BITS, BLOCK, GIVEN = 25, 1 << 20, 16 << 20
#: Rounds of pointer jumping: chains of bases are shorter than two to this power.
JUMPS = 24


class Blocks:
    """Ranges of files, read a block at a time; the blocks used last are kept."""

    def __init__(self, paths: list[str], kept: int = 32) -> None:
        self.paths, self.kept = paths, kept
        self.files: dict[int, tuple] = {}
        self.blocks: OrderedDict[tuple[int, int], bytes] = OrderedDict()

    def take(self, k: int, start: int, end: int) -> bytes:
        first, last = start // BLOCK, (end - 1) // BLOCK
        if last - first > 1:
            return self._read(k, start, end - start)
        data = b"".join(self._block(k, b) for b in range(first, last + 1))
        return data[start - first * BLOCK : end - first * BLOCK]

    def _block(self, k: int, b: int) -> bytes:
        if (k, b) in self.blocks:
            self.blocks.move_to_end((k, b))
        else:
            self.blocks[k, b] = self._read(k, b * BLOCK, BLOCK)
            if len(self.blocks) > self.kept:
                self.blocks.popitem(last=False)
        return self.blocks[k, b]

    def _read(self, k: int, at: int, n: int) -> bytes:
        if k not in self.files:
            fs, path = place(self.paths[k])
            self.files[k] = fs.open_input_file(path)
        return self.files[k].read_at(n, at)


def index(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names (rows of 20 bytes), checksums, places and ends of a pack's objects; size: the pack's."""
    if data[:8] != MAGIC or hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise Malformed("not an index of version 2")
    n, at = int.from_bytes(data[1028:1032]), 1032
    names = np.frombuffer(data, np.uint8, 20 * n, at).reshape(n, 20)
    sums = np.frombuffer(data, ">u4", n, at + 20 * n).astype(np.int64)
    places = np.frombuffer(data, ">u4", n, at + 24 * n).astype(np.int64)
    far = places >> 31 == 1
    wide = np.frombuffer(data, ">u8", (len(data) - 40 - at - 28 * n) // 8, at + 28 * n).astype(np.int64)
    places[far] = wide[places[far] & 0x7FFFFFFF]
    order = np.argsort(places)
    ends = np.empty(n, np.int64)
    ends[order] = np.append(places[order][1:], size - 20)[:n]
    if n and (places.min() < 12 or (ends <= places).any()):
        raise Malformed("an index that points outside its pack")
    return names, sums, places, ends


def _entries(indexes: DataFrame, number: dict[str, int], paths: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = number[path[: -len(".idx")]]
                fs, where = place(paths[k])
                names, sums, places, ends = index(data.as_py(), fs.get_file_info(where).size)
                for i in range(0, len(places), 100_000):
                    cut = slice(i, i + 100_000)
                    oids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(20), len(places[cut]), [None, pa.py_buffer(names[cut].tobytes())])
                    node = (k << PLACE_BITS) + places[cut]
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((k << PLACE_BITS) + ends[cut]), pa.array(sums[cut]), oids.cast(pa.binary())], names=["node", "until", "crc", "oid"])

    return indexes.select("path", "content").mapInArrow(run, "node long, until long, crc long, oid binary")


def _heads(entries: DataFrame, paths: list[str]) -> DataFrame:
    """Entries with their kind and their base's place or name; each range is read by one task."""
    low = (1 << PLACE_BITS) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = Blocks(paths, 4)
        for pdf in batches:
            made = []
            for node, until in zip(pdf["node"].tolist(), pdf["until"].tolist(), strict=True):
                kind, _, base, _ = entry_head(blocks.take(node >> PLACE_BITS, node & low, min(until & low, (node & low) + 48)), node)
                made.append((kind, base if kind == 6 else None, base if kind == 7 else None))
            yield pdf.assign(kind=[m[0] for m in made], up=pd.array([m[1] for m in made], "Int64"), base=[m[2] for m in made])

    dealt = entries.withColumn("range", F.shiftright("node", RANGE_BITS)).repartition("range").sortWithinPartitions("node").drop("range")
    return dealt.mapInPandas(run, "node long, until long, crc long, oid binary, kind int, up long, base binary")


def _tops(rounds: Rounds, nodes: DataFrame) -> DataFrame:
    """The end of each node's chain of bases."""
    now = rounds.write(nodes.select("node", F.coalesce("up", "node").alias("top"), F.col("up").isNull().alias("ends")))
    for _ in range(JUMPS):
        met = now.join(now.select(F.col("node").alias("top"), F.col("top").alias("next")), "top", "left")
        moved = rounds.write(met.select("node", F.col("next").alias("top"), "ends", (F.col("next") != F.col("top")).alias("moved")))
        lost, more, round_again = moved.agg(F.count_if(F.col("top").isNull()), F.count_if("moved"), F.count_if(~F.col("ends") & (F.col("node") == F.col("top")))).first()
        if lost:
            raise Malformed("a delta without its base")
        if round_again:
            break
        now = moved.drop("moved")
        rounds.keep_last(1)
        if not more:
            return now.select("node", "top")
    raise Malformed("deltas that are bases of each other")


def objects(spark: SparkSession, indexes: DataFrame, packs: list[str], loose_names: DataFrame) -> DataFrame:
    """oid, kind, content of the objects of indexed packs that are not loose too.

    indexes: path and content of index files; packs: the paths of their packs; loose_names: oid and path of loose objects.
    """
    paths = sorted(packs)
    rounds = Rounds(spark, "packs")
    entries = _entries(indexes, {p[: -len(".pack")]: k for k, p in enumerate(paths)}, paths)
    heads = rounds.write(_heads(entries, paths))
    pack = F.shiftright("node", PLACE_BITS)
    named = heads.filter("base is not null").select("node", "base", pack.alias("pack"))
    holders = heads.select(F.col("oid").alias("base"), F.col("node").alias("at"), pack.alias("of"))
    found = named.join(holders, "base", "left").groupBy("node", "base").agg(F.coalesce(F.min(F.when(F.col("of") == F.col("pack"), F.col("at"))), F.min("at")).alias("held"))
    found = found.join(loose_names.select(F.col("oid").alias("base"), F.col("path").alias("file")), "base", "left").select("node", "held", F.when(F.col("held").isNull(), F.col("file")).alias("file"))
    first = heads.groupBy("oid").agg(F.min("node").alias("node")).join(loose_names.select("oid"), "oid", "left_anti").select("node", F.lit(True).alias("given"))
    nodes = heads.join(found, "node", "left").join(first, "node", "left").select("node", "until", "crc", "oid", "kind", F.coalesce("up", "held").alias("up"), "file", F.coalesce("given", F.lit(False)).alias("given"))
    nodes = rounds.write(nodes)
    if not nodes.filter("kind in (6, 7) and up is null and file is null").isEmpty():
        raise Malformed("a delta without its base")
    tops = _tops(Rounds(spark, "pack-tops"), nodes)
    dealt = nodes.join(tops, "node").withColumn("range", F.shiftright("top", RANGE_BITS)).repartition("range").sortWithinPartitions("top", "node").drop("range")
    return dealt.mapInArrow(_reader(paths), "oid binary, kind string, content binary")


def _reader(paths: list[str]):
    low = (1 << PLACE_BITS) - 1

    def entry(blocks: Blocks, row: dict) -> bytes:
        at, end = row["node"] & low, row["until"] & low
        raw = blocks.take(row["node"] >> PLACE_BITS, at, end)
        if zlib.crc32(raw) != row["crc"]:
            raise Malformed("an entry of a pack is damaged")
        _, size, _, begins = entry_head(raw, row["node"])
        d = zlib.decompressobj()
        content = d.decompress(raw[begins:], size + 1)
        if size > MAX_OBJECT or len(content) != size:
            raise Malformed("an object has another size than it says")
        return content

    def tree(rows: list[dict], blocks: Blocks) -> Iterator[tuple[bytes, str, bytes]]:
        """The objects of one chain's end and of all deltas above it, bases first."""
        above: dict[int, list[dict]] = {}
        for row in rows:
            if row["up"] is not None:
                above.setdefault(row["up"], []).append(row)
            else:
                end = row
        made = entry(blocks, end)
        if end["file"] is not None:
            fs, path = place(end["file"])
            kind, base = loose(fs.open_input_file(path).read())
            made = apply_delta(base, made)
        else:
            kind = KINDS[end["kind"]]
        todo: list[tuple[dict, bytes | None]] = [(end, None)]
        while todo:
            row, base = todo.pop()
            content = made if base is None else apply_delta(base, entry(blocks, row))
            if object_id(kind, content) != row["oid"]:
                raise Malformed("an object does not hash to its name")
            if row["given"]:
                yield row["oid"], kind, content
            todo.extend((child, content) for child in above.get(row["node"], ()))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["top"] != held[0]["top"]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, out, size = Blocks(paths), [], 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.string(), pa.binary()))], names=["oid", "kind", "content"])

        for rows in trees(batches):
            for made in tree(rows, blocks):
                if out and size + len(made[2]) > GIVEN:
                    yield given()
                    out, size = [], 0
                out.append(made)
                size += len(made[2])
        if out:
            yield given()

    return run
