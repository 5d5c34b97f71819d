"""Tokens of two vocabularies aligned by a dangling-suffix transducer, and how the linked ids go together corpus-wide.

Both sides spell the same bytes.  The transducer's state is the side that leads and its unmatched bytes, a suffix of its
last token.  It takes the next token of the other side: either the token is used up and less of the suffix dangles, or
it reaches beyond and its own rest dangles.  An empty rest closes a group.  Each step overlaps exactly two tokens, the
taken one and the leader's last, which are linked.  States are interned and remember where each token led.

Texts are cut into chunks that no token reaches across (`chunks`), and equal chunks are encoded and aligned once while a
worker remembers them.  Counts are corpus-wide: a batch of about `BATCH_BYTES` of text (or one longer text) has a
dictionary of its distinct pairs with the number of its documents that hold each; dictionaries meet by pair, where a
frequent pair has one row per batch instead of one per document, and the counts go back to the batches.  The most
frequent partners of an id are found among its pairs, of which there are no more than ids of the other vocabulary.

Cases: a null or empty text, and one whose tokens on either side do not spell it, has no tokens; null ids and repeated
rows are documents of their own; empty tables give no rows; extra columns of any name are ignored; memory grows with
the longest text only.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Chunks
from .common import Stages
from .tokens import _byte_letters

#: Bytes of text whose pairs share a dictionary.
BATCH_BYTES = 4_000_000
#: Transitions that a transducer remembers.
TRANSITIONS = 1_000_000
#: Stands for a space in the pieces of the second vocabulary.
SPACE = "▁"
#: Three counts share a number, which is added up at once: tokens of both sides and groups, 40 bits each.
_FIELD = (1 << 40) - 1


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class State:
    """The side that leads (0, 1), its unmatched bytes, and the states that tokens of the other side led to."""

    __slots__ = ("rest", "seen", "side")

    def __init__(self, side: int, rest: bytes) -> None:
        self.side, self.rest, self.seen = side, rest, {}


class Transducer:
    def __init__(self, spelled: tuple[list[bytes], list[bytes]]) -> None:
        self.spelled = spelled
        self._forget()

    def _forget(self) -> None:
        self.even, self.states, self.kept = State(1, b""), {}, 0

    def _state(self, side: int, rest: bytes) -> State:
        if not rest:
            return self.even
        found = self.states.get((side, rest))
        if found is None:
            found = self.states[side, rest] = State(side, rest)
        return found

    def step(self, state: State, token: int) -> State | None:
        """The state after a token of the side that does not lead (the first side when none does); None if bytes differ."""
        found = state.seen.get(token, False)
        if found is False:
            taken, rest = self.spelled[1 - state.side][token], state.rest
            if rest.startswith(taken):
                found = self._state(state.side, rest[len(taken) :])
            elif taken.startswith(rest):
                found = self._state(1 - state.side, taken[len(rest) :])
            else:
                found = None
            state.seen[token] = found
            self.kept += 1
        return found

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """Where groups end on both sides, and the linked pairs (first id << 32 | second id) in order; None if bytes differ."""
        if self.kept > TRANSITIONS:
            self._forget()
        groups, links, i, j = [], [], 0, 0
        n, m, last = len(a), len(b), 0
        even = state = self.even
        while i < n or j < m:
            if state.side == 1:
                if i == n:
                    return None
                token = a[i]
                i += 1
                if state is not even:
                    links.append(token << 32 | b[j - 1])
                last = token << 32
            else:
                if j == m:
                    return None
                token = b[j]
                j += 1
                links.append(last | token)
            state = state.seen.get(token) or self.step(state, token)
            if state is even:
                groups.append((i, j))
            elif state is None:
                return None
        return (groups, links) if state is even else None


class Pair:
    """One worker's two vocabularies, transducer and remembered chunks."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {ord(c): b for b, c in _byte_letters().items()}
        entries = sorted(((i, token) for token, i in self.a.get_vocab(with_added_tokens=True).items()))
        of_a = [b""] * (entries[-1][0] + 1)
        for i, token in entries:
            of_a[i] = bytes(letters[ord(c)] for c in token) if all(ord(c) in letters for c in token) else token.encode()
        of_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.spelled, self.names = (of_a, of_b), tuple([str(i) for i in range(len(of))] for of in (of_a, of_b))
        self.transducer = Transducer(self.spelled)
        self.chunks = Chunks(self._learn, inner=SPACE)

    def _learn(self, new: list[str]) -> list[tuple[int, str, bytes] | None]:
        """What chunks hold: their counts, the text of their groups, and linked pairs; None if the tokens do not spell the chunk."""
        out: list[tuple[int, str, bytes] | None] = []
        of_a, (names_a, names_b) = self.spelled[0], self.names
        for chunk, a, b in zip(new, self.a.encode_batch_fast(new, add_special_tokens=False), self.b.encode([c[1:] for c in new], num_threads=1), strict=True):
            ids = a.ids
            made = self.transducer.align(ids, b) if b"".join([of_a[i] for i in ids]) == chunk.encode() else None
            if made is None:
                out.append(None)
                continue
            groups, links = made
            text, i, j = [], 0, 0
            for i1, j1 in groups:
                left = names_a[ids[i]] if i1 - i == 1 else ",".join([names_a[x] for x in ids[i:i1]])
                right = names_b[b[j]] if j1 - j == 1 else ",".join([names_b[x] for x in b[j:j1]])
                text.append(f"{left}|{right}")
                i, j = i1, j1
            out.append((len(ids) << 80 | len(b) << 40 | len(groups), ";".join(text), array("q", links).tobytes()))
        return out

    def align(self, texts: list[str | None]) -> list[list[tuple[int, str, bytes]]]:
        """What the chunks of each text hold; nothing for texts without tokens."""
        values = self.chunks.values([t or "" for t in texts])
        return [[] if not text or None in held else held for text, held in zip(texts, values, strict=True)]


_pairs: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """One pair of vocabularies per worker process."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def _columns(held: list[list[tuple]]) -> list[pa.Array]:
    """Counts and groups of each text, its distinct pairs by their place in the batch's dictionary, and the dictionary."""
    sides = [tuple(zip(*h, strict=True)) or ((), (), ()) for h in held]
    sums = [sum(counts) for counts, _, _ in sides]
    counts = [pa.array([n >> shift & _FIELD for n in sums], pa.int64()) for shift in (80, 40, 0)]
    groups = pa.array([";".join(texts) for _, texts, _ in sides], pa.string())
    data = [b"".join(links) for _, _, links in sides]
    sizes = np.array([len(d) // 8 for d in data], np.int64)
    words, which = np.unique(np.frombuffer(b"".join(data), "<i8"), return_inverse=True)
    width = max(len(words), 1)
    cells, times = np.unique(np.repeat(np.arange(len(held)), sizes) * width + which, return_counts=True)
    doc, at = cells // width, cells % width
    ends = np.searchsorted(doc, np.arange(len(held) + 1)).astype(np.int32)
    own = np.full(len(held) + 1, len(words), np.int32)
    own[0] = 0
    listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return [
        *counts,
        pa.array(sizes),
        groups,
        listed(ends, at.astype(np.int32)),
        listed(ends, times.astype(np.int32)),
        listed(own, words),
        listed(own, np.bincount(at, minlength=len(words)).astype(np.int32)),
    ]


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, at array<int>, times array<int>, pairs array<long>, held array<int>"


def align(docs: DataFrame, vocabularies: tuple[str, str] | None = None, *, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Documents with their aligned tokens.

    `groups` lists the groups in order, each the first side's ids, a bar and the second's.  `at` and `times` are the
    document's distinct linked pairs, as places in the dictionary of its batch, and how often it links each.  The first
    row of a batch carries the dictionary: `pairs` (first id << 32 | second id) and by how many documents each is `held`.
    """
    path_a, path_b = vocabularies or default_vocabularies()
    names = ["batch", "doc_id", *(f.split()[0] for f in _FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = pair(path_a, path_b), TaskContext.get().partitionId() << 32
        ids: list[Any] = []
        held: list[list[tuple]] = []
        size = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([made] * len(held), pa.int64()), pa.concat_arrays(ids), *_columns(held)], names=names)

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                hi = min(lo + max(1, int(np.searchsorted(np.cumsum(lengths[lo:]), batch_bytes - size, "right"))), lo + 512)
                part = batch.slice(lo, hi - lo)
                held += own.align(part.column(1).to_pylist())
                ids.append(part.column(0))
                size += int(lengths[lo:hi].sum())
                lo = hi
                if size >= batch_bytes:
                    yield full()
                    ids, held, size, made = [], [], 0, made + 1
        if held:
            yield full()

    kind = docs.select(F.col(doc_id)).schema[0].dataType
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("doc_id", kind), *T._parse_datatype_string(_FIELDS).fields])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(batch, place, pair, count, best): the dictionaries' pairs, how many documents of all hold each, and whether that is the most of its first id."""
    places = aligned.filter(F.size("pairs") > 0).select("batch", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "p"))
    places = places.select("batch", "place", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = places.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return places.drop("held").join(counts, "pair")


def _sums(docs: pa.Table, answers: pa.Table) -> tuple[list[int], list[int]]:
    """Per document of a batch: links whose pair is its first id's most frequent, and the counts of all links added up."""
    top = answers.num_rows
    count, best = np.zeros(top, np.int64), np.zeros(top, bool)
    place = answers["place"].to_numpy()
    count[place], best[place] = answers["count"].to_numpy(), answers["best"].to_numpy(zero_copy_only=False)
    at, times = docs["at"].combine_chunks(), docs["times"].combine_chunks()
    cells, weights = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(docs.num_rows), np.asarray(at.value_lengths()))
    sums = []
    for each in (weights * best[cells], weights * count[cells]):
        out = np.zeros(docs.num_rows, np.int64)
        np.add.at(out, owner, each)
        sums.append(out)
    return sums[0], sums[1]


def counted(docs: DataFrame, vocabularies: tuple[str, str] | None = None, *, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum and the digest of its groups."""
    stages = Stages(docs.sparkSession, "crosstok")
    made = align(docs, vocabularies, doc_id=doc_id, text=text, batch_bytes=batch_bytes)
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    made = stages.write(made.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    answers = pair_counts(made).select(F.col("batch").alias("of_batch"), "place", "count", "best")
    rows = made.drop("pairs", "held")
    keep = [f for f in rows.schema.fields if f.name not in ("batch", "at", "times")]

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        best, total = _sums(left, right)
        out = left.select([f.name for f in keep])
        return out.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))

    schema = T.StructType([*keep, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return rows.groupBy("batch").cogroup(answers.groupBy("of_batch")).applyInArrow(summed, schema)
