"""Artifact files as a Spark source and sink: frames are the unit of work, none of them is held by the driver.

    artifact.write(contents, "file:/shared/h.art", magic, (0, 3, 0), metadata)   # contents: blob_id, content, order columns
    artifact.read(spark, "file:/shared/h.art", magic)                             # rank, blob_id, length, content

Writing: contents are ordered and cut into frames (`frames`); tasks compress frames and write them as parts, whose
manifest, by rank, is the sink's commit; one task then copies the parts into the file frame by frame, as its digest is
over all contents in order, and the file appears under its name in one step.  Reading: the heads of frames and the blob
table are walked once, without their contents, and cut into partitions of about `PART_BYTES`; each task inflates its own
frames one at a time and checks every content against its id.  Paths are those of pyarrow's file systems; all executors
must see them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.canon import NonCanonical, deflated, inflated, uvarint
from ..operators import frames
from ..storage import written

FORMAT = 2
#: Stored bytes that one task reads, at least one frame.
PART_BYTES = 64 << 20
#: Frames of a run that one task writes.
PART_FRAMES = 32
#: Rows and bytes of a batch that a reading task hands on.
_ROWS, _BYTES = 256, 8 << 20


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a file that tasks open themselves."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])


class _Bytes:
    """Reads of a file from a place on, without holding more than is asked for."""

    def __init__(self, path: str, at: int = 0) -> None:
        where, name = place(path)
        self.raw = where.open_input_file(name)
        self.end = self.raw.size()
        self.at, self.window, self.base = at, b"", 0

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise NonCanonical("the file ends too soon")
        if not self.base <= self.at or self.at + n > self.base + len(self.window):
            self.window, self.base = self.raw.read_at(min(max(n, 1 << 16), self.end - self.at), self.at), self.at
        lo = self.at - self.base
        self.at += n
        return self.window[lo : lo + n]

    def number(self) -> int:
        n = shift = 0
        while True:
            (b,) = self.take(1)
            n |= (b & 127) << shift
            if b < 128:
                if (not b and shift) or n >> 64:
                    raise NonCanonical("a number is not minimal")
                return n
            shift += 7
            if shift > 63:
                raise NonCanonical("a number does not end")

    def frame(self) -> tuple[int, int, int]:
        """codec, raw length, stored length; the stored bytes come next."""
        codec, raw, stored = self.number(), self.number(), self.number()
        if self.at + stored > self.end:
            raise NonCanonical("a frame does not end")
        return codec, raw, stored

    def inflate(self) -> bytes:
        codec, raw, stored = self.frame()
        return inflated(codec, raw, self.take(stored))


@dataclass
class _Head:
    version: tuple[int, ...]
    digest: bytes
    frames_at: int


def head(path: str, magic: bytes, readable: tuple[int, ...] = (3,)) -> _Head:
    """Magic, format and version, checked in this order."""
    f = _Bytes(path)
    if f.end < len(magic) or f.take(len(magic)) != magic:
        raise NonCanonical("not an artifact")
    (form,) = f.take(1)
    if form != FORMAT:
        raise NonCanonical(f"unknown artifact format {form}")
    version = tuple(f.number() for _ in range(3))
    if version[0] != 0 or version[1] not in readable:
        raise NonCanonical(f"contract {version[0]}.{version[1]} is not read")
    return _Head(version, f.take(32), f.at)


@dataclass
class Slice(InputPartition):
    """Frames from a place on; for contents also the place of their rows in the blob table and their first rank."""

    frames_at: int
    n_frames: int
    first: int
    table_at: int = 0
    n_rows: int = 0


def metadata_slices(path: str, at: int, part_bytes: int) -> tuple[list[Slice], int]:
    """Partitions of the metadata's frames, and where the frames end."""
    f = _Bytes(path, at)
    out, number, size = [], 0, part_bytes
    for number in range(f.number()):
        if size >= part_bytes:
            out.append(Slice(f.at, 0, number))
            size = 0
        _, raw, stored = f.frame()
        if raw > frames.LIMIT or not raw:
            raise NonCanonical("frames do not match the packing rule")
        f.at += stored
        size += stored
        out[-1].n_frames += 1
    return out, f.at


def _grouped(table: _Bytes, count: int) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    """Where each frame's rows start in the blob table, and the rows, by the greedy rule."""
    at, held, rows = table.at, 0, []
    for _ in range(count):
        here = table.at
        blob, n = table.take(32), table.number()
        if rows and held + n > frames.LIMIT:
            yield at, rows
            at, held, rows = here, 0, []
        held += n
        rows.append((blob, n))
    if rows:
        yield at, rows


def content_slices(path: str, at: int, part_bytes: int) -> Iterator[Slice]:
    """Partitions of the contents' frames: the blob table and the heads of frames are walked side by side."""
    table = _Bytes(path, at)
    count = table.number()
    rows_at = table.at
    for _ in range(count):
        table.take(32), table.number()
    f, table = _Bytes(path, table.at), _Bytes(path, rows_at)
    left, rank, now, size = f.number(), 0, None, 0
    for table_at, rows in _grouped(table, count):
        if not left:
            raise NonCanonical("frames do not match the packing rule")
        if now is None or size >= part_bytes:
            if now is not None:
                yield now
            now, size = Slice(f.at, 0, rank, table_at, 0), 0
        _, raw, stored = f.frame()
        if raw != sum(n for _, n in rows):
            raise NonCanonical("frames do not match the packing rule")
        f.at += stored
        left, size, rank = left - 1, size + stored, rank + len(rows)
        now.n_frames, now.n_rows = now.n_frames + 1, now.n_rows + len(rows)
    if left or f.at != f.end:
        raise NonCanonical("frames do not match the packing rule")
    if now is not None:
        yield now


SCHEMAS = {"contents": "rank bigint, blob_id binary, length bigint, content binary", "metadata": "frame bigint, data binary", "digest": "stated binary, found binary, blobs bigint, bytes bigint"}


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.magic, self.table = options["path"], bytes.fromhex(options["magic"]), options.get("table", "contents")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        start = head(self.path, self.magic).frames_at
        if self.table == "digest":
            return [Slice(start, 0, 0)]
        slices, at = metadata_slices(self.path, start, self.part_bytes)
        found = slices if self.table == "metadata" else list(content_slices(self.path, at, self.part_bytes))
        return found or [Slice(start, 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        return {"contents": self._contents, "metadata": self._metadata, "digest": self._digest}[self.table](part)

    def _metadata(self, part: Slice) -> Iterator[pa.RecordBatch]:
        f = _Bytes(self.path, part.frames_at)
        for k in range(part.n_frames):
            yield pa.RecordBatch.from_arrays([pa.array([part.first + k], pa.int64()), pa.array([f.inflate()], pa.binary())], names=["frame", "data"])

    def _contents(self, part: Slice) -> Iterator[pa.RecordBatch]:
        f, table = _Bytes(self.path, part.frames_at), _Bytes(self.path, part.table_at)
        rows, size, rank = [], 0, part.first

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["rank", "blob_id", "length", "content"])

        for _, held in _grouped(table, part.n_rows):
            data, at = f.inflate(), 0
            for blob, n in held:
                content = data[at : at + n]
                if len(content) != n or hashlib.sha256(content).digest() != blob:
                    raise NonCanonical("a blob is not its id")
                rows.append((rank, blob, n, content))
                at, rank, size = at + n, rank + 1, size + n
                if len(rows) >= _ROWS or size >= _BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    def _digest(self, part: Slice) -> Iterator[pa.RecordBatch]:
        """The digest of the whole logical stream, frame by frame in one task, as its order is part of it."""
        stated = head(self.path, self.magic)
        f = _Bytes(self.path, stated.frames_at)
        n = f.number()
        heads, total = f.at, 0
        for _ in range(n):
            _, raw, stored = f.frame()
            f.at += stored
            total += raw
        f.at = heads
        made = hashlib.sha256(b"".join(map(uvarint, stated.version)) + uvarint(total))
        for _ in range(n):
            made.update(f.inflate())
        blobs, size = f.number(), 0
        made.update(uvarint(blobs))
        for _ in range(blobs):
            made.update(f.take(32))
            k = f.number()
            size += k
            made.update(uvarint(k))
        for _ in range(f.number()):
            made.update(f.inflate())
        if f.at != f.end:
            raise NonCanonical("bytes behind the last frame")
        yield pa.RecordBatch.from_arrays([pa.array([stated.digest], pa.binary()), pa.array([made.digest()], pa.binary()), pa.array([blobs], pa.int64()), pa.array([size], pa.int64())], names=["stated", "found", "blobs", "bytes"])


@dataclass
class Part(WriterCommitMessage):
    """Files of one task: frames of one section (0 metadata, 1 contents), with the first frame's number."""

    files: list[tuple[int, int, int, int, str]]


class Writer(DataSourceArrowWriter):
    """Writes rows (section, frame, rank, blob_id, content), sorted, as parts; the commit is a manifest of parts by rank."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, base = place(self.path)
        where.create_dir(base, recursive=True)
        made: list[tuple[int, int, int, int, str]] = []
        key, held, table = None, [], []
        name, streams, first, n_frames, n_blobs = "", [], 0, 0, 0

        def shut() -> None:
            nonlocal streams
            for s in streams:
                s.close()
            if streams:
                made.append((key[0], first, n_frames, n_blobs, name))
            streams = []

        def flush() -> None:
            nonlocal n_frames
            raw = b"".join(held)
            codec, stored = deflated(raw)
            streams[0].write(uvarint(codec) + uvarint(len(raw)) + uvarint(len(stored)))
            streams[0].write(stored)
            streams[1].write(b"".join(table))
            n_frames += 1

        for batch in iterator:
            for section, frame, blob, content in zip(*(batch.column(c).to_pylist() for c in ("section", "frame", "blob_id", "content")), strict=True):
                if (section, frame) != key:
                    if key is not None:
                        flush()
                    if key is None or section != key[0]:
                        shut()
                        name, first, n_frames, n_blobs = f"part-{uuid.uuid4().hex}", frame, 0, 0
                        streams = [where.open_output_stream(f"{base}/{name}.{kind}") for kind in ("frames", "table")]
                    key, held, table = (section, frame), [], []
                held.append(content)
                if section:
                    table.append(blob + uvarint(len(content)))
                    n_blobs += 1
        if key is not None:
            flush()
        shut()
        return Part(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted(tuple(f) for m in messages if m is not None for f in m.files)
        for section in (0, 1):
            at = 0
            for _, first, n, _, _ in (p for p in parts if p[0] == section):
                if first != at:
                    raise NonCanonical("frames are missing or twice")
                at += n
        where, base = place(self.path)
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/manifest.tmp") as out:
            out.write(json.dumps(parts).encode())
        where.move(f"{base}/manifest.tmp", f"{base}/manifest.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Parts of a failed write have no manifest, so that nothing reads them; the folder goes with the next `write`."""


class Artifact(DataSource):
    """`spark.read.format("artifact")` with options path, magic (hex) and table (contents, metadata or digest)."""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "contents")]

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options))


def read(spark: SparkSession, path: str, magic: bytes, table: str = "contents", part_bytes: int = PART_BYTES) -> DataFrame:
    """contents: rank, blob_id, length, content; metadata: frame, data; digest: what the head states and what is found."""
    spark.dataSource.register(Artifact)
    return spark.read.format("artifact").option("path", path).option("magic", magic.hex()).option("table", table).option("part_bytes", str(part_bytes)).load()


def checked(spark: SparkSession, path: str, magic: bytes) -> None:
    """Raises NonCanonical unless the digest is that of the contents."""
    row = read(spark, path, magic, "digest").first()
    if bytes(row["stated"]) != bytes(row["found"]):
        raise NonCanonical("the digest does not match")


def _joined(folder: str, path: str, magic: bytes, version: tuple[int, int, int]) -> bytes:
    """Copies the parts of a manifest into one file, a frame at a time, and gives it its name in the end."""
    where, base = place(folder)
    with where.open_input_file(f"{base}/manifest.json") as f:
        parts = json.loads(f.read())
    sections = [[p for p in parts if p[0] == s] for s in (0, 1)]
    v = b"".join(map(uvarint, version))

    def each(section: int) -> Iterator[tuple[int, int, bytes]]:
        for _, _, n, _, name in sections[section]:
            f = _Bytes(f"{folder}/{name}.frames")
            for _ in range(n):
                codec, raw, stored = f.frame()
                yield codec, raw, f.take(stored)

    def rows() -> Iterator[bytes]:
        for *_, name in sections[1]:
            with where.open_input_stream(f"{base}/{name}.table") as f:
                while piece := f.read(1 << 20):
                    yield piece

    count = uvarint(sum(p[3] for p in sections[1]))
    made = hashlib.sha256(v + uvarint(sum(raw for _, raw, _ in each(0))))
    for codec, raw, stored in each(0):
        made.update(inflated(codec, raw, stored))
    made.update(count)
    for piece in rows():
        made.update(piece)
    for codec, raw, stored in each(1):
        made.update(inflated(codec, raw, stored))
    to, name = place(path)
    mine = f"{name}.{uuid.uuid4().hex}"
    with to.open_output_stream(mine) as out:
        out.write(magic + bytes([FORMAT]) + v + made.digest())
        for section in (0, 1):
            if section:
                out.write(count)
                for piece in rows():
                    out.write(piece)
            out.write(uvarint(sum(p[2] for p in sections[section])))
            for codec, raw, stored in each(section):
                out.write(uvarint(codec) + uvarint(raw) + uvarint(len(stored)))
                out.write(stored)
    to.move(mine, name)
    return made.digest()


def write(contents: DataFrame, path: str, magic: bytes, version: tuple[int, int, int] = (0, 3, 0), metadata: bytes = b"", order: list[str] | None = None) -> bytes:
    """Writes distinct contents (blob_id, content) in the order of the given columns, blob_id last; the digest comes back."""
    spark = contents.sparkSession
    spark.dataSource.register(Artifact)
    order = [c for c in order or [] if c != "blob_id"] + ["blob_id"]
    own = written(contents.select(*order, "content", F.octet_length("content").cast("long").alias("_length")), "contents")
    packed = frames.framed(own.drop("content"), order, "_length").select("blob_id", "frame", "rank")  # contents are not moved to find frames
    rows = own.select("blob_id", "content").join(packed, "blob_id").select(F.lit(1).alias("section"), "frame", "rank", "blob_id", "content")
    pieces = [(0, k, k, None, metadata[lo : lo + frames.LIMIT]) for k, lo in enumerate(range(0, len(metadata), frames.LIMIT))]
    rows = rows.unionAll(spark.createDataFrame(pieces, "section int, frame long, rank long, blob_id binary, content binary"))
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    # a task writes a run of frames, and no content is read to find out where runs end; two frames in turn hold more than the limit
    most = max(2 * (own.agg(F.sum("_length")).first()[0] or 0) // frames.LIMIT + 1, len(pieces))
    dealt = rows.repartitionById(most // PART_FRAMES + 1, F.floor(F.col("frame") / PART_FRAMES).cast("int"))
    dealt.sortWithinPartitions("section", "frame", "rank").write.format("artifact").option("path", folder).mode("append").save()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_joined(folder, path, magic, version)], pa.binary())], names=["digest"])

    digest = bytes(spark.range(1).coalesce(1).mapInArrow(join, "digest binary").first()[0])
    where, base = place(folder)
    where.delete_dir(base)
    return digest
