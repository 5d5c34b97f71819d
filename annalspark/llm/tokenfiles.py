"""Training-order materialisation: token sequences in a keyed pseudo-random order, as fixed-stride binary shards.

1. Documents are encoded once; each task joins its documents' ids (each document ended by id 0) into sequences of
   `length` ids and writes them, compressed, to a stage table, so every sequence has a lasting number.
2. Sequences get a dense index (a running count over the tasks' totals) and a global slot: a keyed Feistel permutation
   of the smallest even-bit domain that holds all indexes, walked until the slot lies inside.  Slots are a bijection,
   so no slot is empty or taken twice, and any slot's sequence can be named without reading the others.
3. Shard s holds slots [s * per_shard, (s + 1) * per_shard): sequences go to their shard's task by its number, are
   sorted by slot and written with Spark's committing writer, one file per shard.  A record is `length` little-endian
   16- or 32-bit ids and one newline byte, so slot k of a shard starts at byte k * stride: readers seek and resume.

A lost executor costs a task's re-run; uncommitted files are never seen.  No sequence meets another than its shard's.

Cases: a null text is an empty one (only its separator); null ids are allowed; repeated rows are written each; an empty
table gives no rows and no shards; extra columns are ignored; long texts span sequences.  The last sequence of a task
is filled up with id 0 and its true number of tokens is reported.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import tokens
from .common import Stages

ROUNDS = 6


@dataclass(frozen=True)
class ShardParams:
    length: int = tokens.SEQUENCE
    per_shard: int = 4096
    key: int = 0x5EED


def _round_keys(key: int) -> list[int]:
    """Odd 31-bit multipliers drawn from the key."""
    out, x = [], key & 0xFFFFFFFFFFFFFFFF
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append((x >> 33) | 1)
    return out


def half_bits(n: int) -> int:
    """Bits of each half of the smallest domain for n values."""
    return max(1, -(-max(1, (max(n, 2) - 1).bit_length()) // 2))


def feistel(index: int, n: int, key: int) -> int:
    """Slot of an index among n: the plain form, for readers and tests."""
    bits = half_bits(n)
    mask, x = (1 << bits) - 1, index
    while True:
        left, right = x >> bits, x & mask
        for k in _round_keys(key):
            mixed = ((right + k) * k) & 0x7FFFFFFFFFFFFFFF
            left, right = right, left ^ (((mixed >> 17) ^ mixed) & mask)
        x = (left << bits) | right
        if x < n:
            return x


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of many indexes.  The domain is less than four times n, so a quarter or more arrive at each pass."""
    bits, x = half_bits(n), index.astype(np.uint64)
    mask, todo = np.uint64((1 << bits) - 1), np.arange(len(index))
    while len(todo):
        left, right = x[todo] >> np.uint64(bits), x[todo] & mask
        for k in map(np.uint64, _round_keys(key)):
            mixed = ((right + k) * k) & np.uint64(0x7FFFFFFFFFFFFFFF)
            left, right = right, left ^ (((mixed >> np.uint64(17)) ^ mixed) & mask)
        x[todo] = (left << np.uint64(bits)) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


SEQUENCES = "task long, number long, n_tokens long, ids_crc32 long, first_doc long, n_docs long, ids binary"


def sequences(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """Sequences of each task's documents, numbered from 0 within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, number = tokens.encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        width, two_bytes = length * 4, tokens.encoder(vocabulary).whole.get_vocab_size() <= 1 << 16
        rest, owners = b"", []  # what is not yet written; (doc_id, bytes) of its documents in order
        squeeze = zstandard.ZstdCompressor(level=3).compress

        def cut(last: bool) -> Iterator[tuple]:
            nonlocal rest, owners, number
            at, k = 0, 0
            while len(rest) - at >= width or (last and at < len(rest)):
                piece = rest[at : at + width]
                took, first, n = len(piece), None, 0
                while took > 0:
                    doc, left = owners[k]
                    first, n = (doc if not n else first), n + 1
                    use = min(left, took)
                    took -= use
                    owners[k] = (doc, left - use)
                    k += left == use
                full = piece + bytes(width - len(piece))
                yield (task, number, len(piece) // 4, zlib.crc32(full), first, n, squeeze(np.frombuffer(full, "<u4").astype("<u2" if two_bytes else "<u4").tobytes()))
                number, at = number + 1, at + width
            rest, owners = rest[at:], owners[k:]

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                chunks = [rest]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    chunks += [ids, b"\0\0\0\0"]
                    owners.append((doc_id, len(ids) + 4))
                rest = b"".join(chunks)
                yield _table(list(cut(False)))
        yield _table(list(cut(True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SEQUENCES)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["task", "number", "n_tokens", "ids_crc32", "first_doc", "n_docs", "ids"])


def materialise(docs: DataFrame, out: str | None = None, vocabulary: str | None = None, params: ShardParams = ShardParams()) -> DataFrame:
    """Writes the shards below `out` (by default a folder of the shared one) and returns their manifest.

    Manifest: index, slot, shard, byte_offset, n_tokens, ids_crc32 (of the ids as 32-bit numbers, filled up),
    first_doc (the document the sequence begins in) and n_docs of every sequence.
    """
    p, stages, vocab = params, Stages(docs.sparkSession, "tokenfiles"), vocabulary or tokens.default_vocabulary()
    every = stages.write(sequences(docs, vocab, p.length), "sequences")
    totals = every.groupBy("task").agg(F.count(F.lit(1)).alias("n"))  # a row per task
    before = F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    base = stages.write(totals.select("task", "n", F.coalesce(before, F.lit(0)).alias("base")), "base")
    n = int(base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    indexed = every.join(base.select("task", "base"), "task").withColumn("index", F.col("base") + F.col("number"))
    stride = p.length * (2 if tokens.encoder(vocab).whole.get_vocab_size() <= 1 << 16 else 4) + 1
    if n:
        _write(_with_slot(indexed.select("index", "ids"), n, p), out or stages.path("shards"), max(1, -(-n // p.per_shard)), p)
    manifest = _with_slot(indexed.select("index", "n_tokens", "ids_crc32", "first_doc", "n_docs"), max(n, 1), p)
    return manifest.select("index", "slot", F.floor(F.col("slot") / p.per_shard).cast("long").alias("shard"), ((F.col("slot") % p.per_shard) * stride).alias("byte_offset"), "n_tokens", "ids_crc32", "first_doc", "n_docs")


def _with_slot(rows: DataFrame, n: int, p: ShardParams) -> DataFrame:
    """Adds the column `slot` to rows whose first column is the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(permute(batch.column(0).to_numpy(), n, p.key))], names=[*batch.schema.names, "slot"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("slot", T.LongType())]))


def _write(rows: DataFrame, path: str, shards: int, p: ShardParams) -> None:
    dealt = rows.select("slot", "ids").repartitionById(shards, F.floor(F.col("slot") / p.per_shard).cast("int")).sortWithinPartitions("slot")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([expand(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["value"])

    dealt.mapInArrow(plain, "value binary").select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
