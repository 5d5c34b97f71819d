"""Byte-level BPE encoding and decoding with the merges done by recursive queries of DuckDB inside each partition.

A text is split by the vocabulary's pattern.  The distinct words of a batch become token-position rows, one per byte;
a recursive query joins neighbouring rows with the merge table and contracts each word's leftmost pair of least rank,
until no pair of a word is in the table.  A word that is in the vocabulary as a whole is one token, as the public
library has it.  Words of more than `LONG` bytes contract, in a round, all pairs of the least rank that one-by-one
contraction would reach before a pair of a lower rank comes up, so that the rounds do not grow with the length of a run.
Decoding joins token-position rows with the vocabulary, and an aggregation in the order of positions puts the bytes of each
list together.

Each worker holds one in-memory database with the vocabulary; rows of a query are bounded by `WORDS_BYTES` (or by the
longest word), so memory grows with the longest text only.  Nothing is shuffled, and a lost task is simply run again.

Cases: a null text is an empty one; empty texts have no ids; null ids and repeated rows are encoded like any other row;
empty tables give no rows; extra columns of any name are ignored by `encode` and `decode`, which return the id column
and their result.  A null list of ids, and one with a null or unknown id, decodes to null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Remembered

#: Words of more bytes are contracted many pairs a round.
LONG = 64
#: Bytes of words that one recursive query takes, and rounds of a query over long words.
WORDS_BYTES, ROUNDS = 1_000_000, 32
#: Texts that are encoded, and lists that are decoded, together; and ids that are decoded together.
TOGETHER, IDS_TOGETHER = 1024, 1_000_000

_SHORT = """
WITH RECURSIVE t AS (
  SELECT word, pos, id, FALSE AS done FROM start
  UNION ALL (
  WITH p AS MATERIALIZED (
    SELECT word, pos, id, CASE WHEN lead(word) OVER w = word THEN id::BIGINT << 32 | lead(id) OVER w END AS pair,
           CASE WHEN lag(word) OVER w = word THEN lag(pos) OVER w END AS prev
    FROM t WHERE NOT done WINDOW w AS (ORDER BY pos)),
  least AS (SELECT word, min(m.rank::BIGINT << 32 | pos) AS key FROM p JOIN merges m ON m.pair = p.pair GROUP BY word)
  SELECT p.word, p.pos, CASE WHEN least.key & 4294967295 = p.pos THEN (least.key >> 32)::INT ELSE id END, least.key IS NULL
  FROM p LEFT JOIN least ON p.word = least.word
  WHERE least.key IS NULL OR prev IS NULL OR prev <> least.key & 4294967295))
SELECT word, pos, id, done FROM t WHERE done"""

_LONG = """
WITH RECURSIVE t AS (
  SELECT word, pos, id, 0 AS round, FALSE AS done FROM start
  UNION ALL (
  WITH p AS MATERIALIZED (
    SELECT word, pos, id, round, row_number() OVER w AS nr, CASE WHEN lead(word) OVER w = word THEN lead(id) OVER w END AS right_id,
           CASE WHEN lead(word, 2) OVER w = word THEN lead(id, 2) OVER w END AS after_id,
           CASE WHEN lag(word) OVER w = word THEN lag(id) OVER w END AS left_id, CASE WHEN lag(word) OVER w = word THEN lag(pos) OVER w END AS prev
    FROM t WHERE NOT done AND round < {rounds} WINDOW w AS (ORDER BY pos)),
  pairs AS MATERIALIZED (SELECT p.word, p.pos, p.nr, p.left_id, p.after_id, m.rank FROM p JOIN merges m ON m.pair = (p.id::BIGINT << 32 | p.right_id)),
  least AS (SELECT word, min(rank) AS rank FROM pairs GROUP BY word),
  hits AS (SELECT h.*, h.nr - row_number() OVER (ORDER BY h.nr) AS run FROM pairs h JOIN least ON h.word = least.word AND h.rank = least.rank),
  apart AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY nr) AS k FROM hits),
  taken AS MATERIALIZED (SELECT *, lag(nr) OVER (ORDER BY nr) AS before FROM apart WHERE k % 2 = 1),
  stop AS (
    SELECT x.word, min(x.pos) AS pos
    FROM taken x LEFT JOIN merges a ON a.pair = (CASE WHEN x.before = x.nr - 2 THEN x.rank ELSE x.left_id END::BIGINT << 32 | x.rank)
                 LEFT JOIN merges b ON b.pair = (x.rank::BIGINT << 32 | x.after_id)
    WHERE a.rank < x.rank OR b.rank < x.rank GROUP BY x.word),
  made AS MATERIALIZED (SELECT x.word, x.pos, x.rank FROM taken x LEFT JOIN stop ON x.word = stop.word WHERE stop.pos IS NULL OR x.pos <= stop.pos)
  SELECT p.word, p.pos, coalesce(made.rank, p.id), round + 1, least.word IS NULL
  FROM p LEFT JOIN made ON p.pos = made.pos LEFT JOIN made gone ON p.prev = gone.pos LEFT JOIN least ON least.word = p.word
  WHERE gone.pos IS NULL))
SELECT word, pos, id, done FROM t WHERE done OR round = {rounds}"""

_BYTES = """
SELECT row, unhex(array_to_string(list(hex ORDER BY pos), '')) AS bytes
FROM tokens JOIN vocabulary USING (id) GROUP BY row ORDER BY row"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def ranks_of(path: str) -> dict[bytes, int]:
    """The tokens of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """One worker's vocabulary, database and remembered words."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb

        self.ranks, self.find = ranks_of(path), regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        pairs = [(self.ranks[b[:i]] << 32 | self.ranks[b[i:]], r) for b, r in self.ranks.items() for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks]
        self._table("merges", pair=np.array([p for p, _ in pairs], np.int64), rank=np.array([r for _, r in pairs], np.int32))
        self._table("vocabulary", id=np.array(list(self.ranks.values()), np.int32), hex=[b.hex() for b in self.ranks])
        top = max(self.ranks.values()) + 1
        self.known = np.zeros(top, bool)
        self.known[list(self.ranks.values())] = True
        self.words = Remembered(self._words)

    def _table(self, name: str, **columns: object) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contract(self, words: list[bytes], sql: str) -> list[bytes]:
        """The ids of words, as bytes of 32-bit numbers."""
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        rows = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "pos": np.arange(len(data), dtype=np.int32), "id": self.byte_ids[data]})
        whole: list[pa.Table] = []
        while rows.num_rows:
            got = self._query(sql, "start", rows)
            done = got["done"].to_numpy()
            whole.append(got.filter(pa.array(done)))
            rows = got.filter(pa.array(~done)).select(["word", "pos", "id"])
        word, pos, ids = (np.concatenate([w[c].to_numpy() for w in whole]) for c in ("word", "pos", "id"))
        ids = ids[np.argsort(pos, kind="stable")].astype("<i4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _words(self, new: list[str]) -> list[bytes]:
        data = [w.encode() for w in new]
        out: list[bytes] = [b""] * len(new)
        short: list[int] = []
        size = 0
        for i, word in enumerate(data):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(word) > LONG:
                (out[i],) = self._contract([word], _LONG.format(rounds=max(1, min(ROUNDS, 8_000_000 // len(word)))))
            else:
                short.append(i)
                size += len(word)
            if short and (size >= WORDS_BYTES or i + 1 == len(data)):
                for k, ids in zip(short, self._contract([data[k] for k in short], _SHORT), strict=True):
                    out[k] = ids
                short, size = [], 0
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit numbers."""
        cut = [self.find(t or "") for t in texts]
        get = self.words.of(cut).__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, lists: list[np.ndarray | None]) -> list[bytes | None]:
        """The bytes of each list of ids; None for a missing list or one with an id out of the vocabulary."""
        out: list[bytes | None] = [None] * len(lists)
        rows: list[int] = []
        size = 0
        for i, ids in enumerate(lists):
            if ids is not None and (not len(ids) or (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all())):
                out[i] = b""
                rows.append(i)
                size += len(ids)
            if rows and (size >= IDS_TOGETHER or i + 1 == len(lists)):
                flat = np.concatenate([lists[k] for k in rows]).astype(np.int32)
                owner = np.repeat(np.array(rows, np.int32), [len(lists[k]) for k in rows])
                found = self._query(_BYTES, "tokens", pa.table({"row": owner, "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
                for k, data in zip(found["row"].to_pylist(), found["bytes"].to_pylist(), strict=True):
                    out[k] = data
                rows, size = [], 0
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, vocabulary and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _row_type(df: DataFrame, doc_id: str) -> T.DataType:
    return df.select(F.col(doc_id)).schema[0].dataType


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text; `vocabulary` is the path of a rank file."""
    path, cut = vocabulary or default_vocabulary(), pattern or _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, cut)
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                found = own.encode(part.column(1).to_pylist())
                offsets = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", _row_type(docs, doc_id)), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str | None = None, *, doc_id: str = "doc_id", ids: str = "ids", keep_ids: bool = False) -> DataFrame:
    """(doc_id, decoded binary): the bytes of every list of ids; keep_ids leaves the ids beside them."""
    path, cut = vocabulary or default_vocabulary(), _pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, cut)
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                lists = part.column(1)
                values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                if lists.values.null_count:
                    values = np.where(lists.values.is_null().to_numpy(zero_copy_only=False), -1, values).astype(np.int64)
                rows = [values[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]
                got = pa.array(own.decode(rows), pa.binary())
                columns = [part.column(0), lists, got] if keep_ids else [part.column(0), got]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"] if keep_ids else ["doc_id", "decoded"])

    fields = [T.StructField("doc_id", _row_type(encoded, doc_id)), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, T.StructType(fields if keep_ids else [fields[0], fields[2]]))


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Ids encoded and decoded again: their number, and the digests of both."""
    back = decode(encode(docs, vocabulary), vocabulary, keep_ids=True)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
