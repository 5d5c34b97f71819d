"""Language-model scoring by deleted interpolation.

P(w | u) = l2 * c(u,w)/c(u) + l1 * c(w)/N + l0 / (V+1), with weights l that depend on the frequency bucket of the
context u.  Counts come from the training documents; the weights are learned by expectation-maximisation on held-out
counts: a fifth of the training documents (by hash) is set apart, the estimates for learning come from the rest.
There is a bucket for every octave of the context's count: 1, 2-3, 4-7 and so on; contexts that were not seen (or fewer
than `min_context` times) share one bucket without a bigram part.

Every count is exact and grows with the corpus, so no table of it is broadcast.  Documents are turned once into batches
(a stage table): word numbers of a batch's own vocabulary.  Each batch asks for the counts of its distinct words, and
then of its distinct bigrams, in a packed exchange: one row per (batch, hash range) with sorted keys and the batch's
own counts; a hash range's task adds the counts up and answers each batch.  A key costs one entry per batch however
frequent it is, so no key is hot.  A bigram is not exchanged if no other batch holds one of its words: its count
is the batch's own.  The driver sees only totals and a histogram of fixed size for the mixture weights.

Cases: a null text is an empty one (its end token is scored); a null id counts as the empty string when the training
part is chosen; repeated rows are scored and counted each; an empty table gives no rows; without training documents all
estimates are uniform; extra columns are ignored; very long texts fill a batch of their own.
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

from . import textvec as tv
from .common import Stages, dealt

U64 = np.uint64
START, END = U64(0x5354415254535441), U64(0x454E44454E44454E)
BATCH = "batch long, ids array<long>, off binary, tok binary, vocab binary, fit binary, em binary"
ANSWER = "batch long, kind int, part int, counts binary, tokens long, types long"


@dataclass(frozen=True)
class LmParams:
    folds: int = 5
    held_fold: int = 1
    #: One of so many training documents is set apart for learning the mixture weights.
    em_share: int = 5
    min_context: int = 1
    batch_bytes: int = 16 << 20
    part_bytes: int = 48 << 20
    rounds: int = 50


def squeeze(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=U64(0)))


def unsqueeze_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64)


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def _roles(ids: list, p: LmParams) -> tuple[np.ndarray, np.ndarray]:
    """Which documents are held out, and which training documents are set apart."""
    crc = np.array([fold_of(i) for i in ids], np.int64)
    held = crc % p.folds == p.held_fold
    return held, ~held & ((crc // p.folds) % p.em_share == 0)


def batches(docs: DataFrame, p: LmParams) -> DataFrame:
    """One row per batch: ids, word numbers, vocabulary and its counts in the two training parts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in stream:
            buf, offs = tv.buffers(batch.column(1))
            all_ids = batch.column(0).to_pylist()
            for a, b in tv.slices(offs, p.batch_bytes):
                ids, hashes, sizes = all_ids[a:b], [], []
                for c, d in tv.slices(offs[a : b + 1]):
                    words = tv.Words(buf, offs[a + c : a + d + 1])
                    hashes.append(words.h)
                    sizes.append(np.diff(words.off))
                size = np.concatenate(sizes) + 2
                off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                stream_h = np.empty(off[-1], U64)
                inner = np.ones(off[-1], bool)
                inner[off[:-1]] = inner[off[1:] - 1] = False
                stream_h[inner] = np.concatenate(hashes)
                stream_h[off[:-1]], stream_h[off[1:] - 1] = START, END
                vocab, at, n = np.unique(stream_h, return_inverse=True, return_counts=True)
                rank = np.argsort(-n, kind="stable")
                back = np.empty(len(rank), np.uint32)
                back[rank] = np.arange(len(rank), dtype=np.uint32)
                held, em = _roles(ids, p)
                of = np.repeat(np.arange(len(ids)), size)
                fit_n = np.bincount(at, ~(held | em)[of], len(vocab)).astype(np.uint32)
                em_n = np.bincount(at, em[of], len(vocab)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([ids], pa.list_(pa.int64()))] + [pa.array([x], pa.binary()) for x in (squeeze(off), squeeze(back[at]), vocab[rank].tobytes(), squeeze(fit_n[rank]), squeeze(em_n[rank]))],
                    names=["batch", "ids", "off", "tok", "vocab", "fit", "em"],
                )
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, BATCH)


def _ask(batch: int, keys: np.ndarray, arrays: list[np.ndarray], parts: int) -> Iterator[list]:
    """Rows (part, batch, sorted keys, arrays) by hash range; keys are sorted."""
    if parts > 1:
        edge = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(U64)
        cut = [0, *np.searchsorted(keys, edge), len(keys)]
    else:
        cut = [0, len(keys)]
    for k in range(parts):
        s = slice(cut[k], cut[k + 1])
        yield [k, batch, squeeze_sorted(keys[s]), *(squeeze(a[s]) for a in arrays)]


def _add(rows: list[dict], names: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys of a range, each one's number per row, and the sums of the named counts."""
    each = [unsqueeze_sorted(r["keys"]) for r in rows]
    keys = tv.distinct(np.concatenate(each)) if each else np.zeros(0, U64)
    place = [np.searchsorted(keys, k) for k in each]
    sums = []
    for name in names:
        total = np.zeros(len(keys), np.int64)
        for r, at in zip(rows, place, strict=True):
            total[at] += unsqueeze(r[name], np.uint32)
        sums.append(total)
    return keys, place, sums


def _unigrams(stage: DataFrame, parts: int) -> DataFrame:
    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for r in b.to_pylist():
                vocab = np.frombuffer(r["vocab"], U64)
                order = np.argsort(vocab)
                rows = list(_ask(r["batch"], vocab[order], [unsqueeze(r["fit"], np.uint32)[order], unsqueeze(r["em"], np.uint32)[order]], parts))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("fit", pa.binary()), ("em", pa.binary())]))

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in stream for r in b.to_pylist()]
        rows.sort(key=lambda r: r["batch"])
        keys, place, (fit, em) = _add(rows, ["fit", "em"])
        words = keys != START
        total = (fit + em)[words]
        alone = np.bincount(np.concatenate(place), minlength=len(keys)) == 1
        for i, (r, at) in enumerate(zip(rows, place, strict=True)):
            known = np.concatenate([fit[at], em[at], alone[at]]).astype(np.int64)
            first = not i
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (r["batch"], 1, r["part"], squeeze(known), int(total.sum()) if first else 0, int((total > 0).sum()) if first else 0)],
                schema=pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())]),
            )

    asked = stage.select("batch", "vocab", "fit", "em").mapInArrow(ask, "part int, batch long, keys binary, fit binary, em binary")
    return dealt(asked, parts, "part").groupBy("part").applyInArrow(add, ANSWER)


def _counts(own: dict, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corpus counts (fit, em) of a batch's vocabulary, in its order, and whether no other batch holds the word."""
    got = [unsqueeze(a["counts"], np.int64).reshape(3, -1) for a in sorted((a for a in answers if a["kind"] == 1), key=lambda a: a["part"])]
    out = np.empty((3, sum(g.shape[1] for g in got)), np.int64)
    out[:, np.argsort(np.frombuffer(own["vocab"], U64))] = np.concatenate(got, axis=1)
    return out[0], out[1], out[2] > 0


def _level(n: np.ndarray) -> np.ndarray:
    """Counts on a scale of four steps an octave; 0 for 0."""
    return np.where(n > 0, np.minimum(1 + np.floor(4 * np.log2(np.maximum(n, 1))), 254), 0).astype(np.uint32)


def _bucket(context: np.ndarray, p: LmParams) -> np.ndarray:
    """Bucket of a context's count: 0 below min_context, else one per octave."""
    return np.where(context >= p.min_context, 1 + np.floor(np.log2(np.maximum(context, 1) / p.min_context)), 0).astype(np.int64)


@dataclass
class Bigrams:
    """Bigrams of a batch: document starts, word numbers, positions of tokens, which have a context that counts; of those
    the distinct hashes, each token's number in them, a token of each, own counts, and which must be asked for."""

    off: np.ndarray
    tok: np.ndarray
    at: np.ndarray
    rich: np.ndarray
    keys: np.ndarray
    inverse: np.ndarray
    src: np.ndarray
    fit: np.ndarray
    em: np.ndarray
    far: np.ndarray


def _bigrams(own: dict, fit: np.ndarray, em: np.ndarray, alone: np.ndarray, p: LmParams) -> Bigrams:
    off, tok = unsqueeze(own["off"], np.int64), unsqueeze(own["tok"], np.uint32)
    is_token = np.ones(len(tok), bool)
    is_token[off[:-1]] = False
    at = np.flatnonzero(is_token)
    rich = (fit + em)[tok[at - 1]] >= p.min_context
    vocab = np.frombuffer(own["vocab"], U64)
    h = tv.mix(tv.mix(vocab[tok[at[rich] - 1]]) * U64(3) + vocab[tok[at[rich]]])
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    src = at[rich][first]
    held, apart = _roles(own["ids"], p)
    of = np.repeat(np.arange(len(held)), np.diff(off))[at[rich]]
    fit_n = np.bincount(inverse, ~(held | apart)[of], len(keys)).astype(np.uint32)
    em_n = np.bincount(inverse, apart[of], len(keys)).astype(np.uint32)
    far = ~alone[tok[src - 1]] & ~alone[tok[src]] & ((fit + em)[tok[src]] > 0)
    return Bigrams(off, tok, at, rich, keys, inverse, src, fit_n, em_n, far)


def _cells(context: np.ndarray, pair: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct histogram cells of three levels, and the held-out counts in each."""
    cell, where = np.unique(((context.astype(np.int64) << 16) | (pair.astype(np.int64) << 8) | word)[n > 0], return_inverse=True)
    return cell, np.bincount(where, n[n > 0], len(cell)).astype(np.int64)


def _ask_bigrams(stage: DataFrame, words: DataFrame, parts: int, p: LmParams) -> DataFrame:
    """Bigram keys of each batch by hash range (part >= 0), and histogram cells of what is not asked for (part = -1)."""
    schema = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("fit", pa.binary()), ("em", pa.binary()), ("context", pa.binary()), ("word", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for own in left.to_pylist():
            fit, em, alone = _counts(own, right.to_pylist())
            g = _bigrams(own, fit, em, alone, p)
            context, word = _level(fit)[g.tok[g.src - 1]], _level(fit)[g.tok[g.src]]
            rows += list(_ask(own["batch"], g.keys[g.far], [g.fit[g.far], g.em[g.far], context[g.far], word[g.far]], parts))
            near = _cells(context[~g.far], _level(g.fit[~g.far]), word[~g.far], g.em[~g.far])
            apart = _roles(own["ids"], p)[1]
            poor = ~g.rich & apart[np.repeat(np.arange(len(apart)), np.diff(g.off))[g.at]]
            cell, n = np.unique(_level(fit)[g.tok[g.at[poor]]], return_counts=True)
            rows.append([-1, own["batch"], squeeze(np.concatenate([cell, near[0]]).astype(np.uint32)), squeeze(np.concatenate([n, near[1]]).astype(np.uint32)), b"", b"", b""])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return stage.groupBy("batch").cogroup(words.groupBy("batch")).applyInArrow(run, "part int, batch long, keys binary, fit binary, em binary, context binary, word binary")


def _answer_bigrams(asked: DataFrame, parts: int) -> DataFrame:
    """Counts for each batch (kind 2), and histogram rows (kind 3): cell number and held-out count."""
    schema = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in stream for r in b.to_pylist()]
        rows.sort(key=lambda r: r["batch"])
        out = []
        if rows and rows[0]["part"] < 0:
            cell, where = np.unique(np.concatenate([unsqueeze(r["keys"], np.uint32) for r in rows]), return_inverse=True)
            n = np.bincount(where, np.concatenate([unsqueeze(r["fit"], np.uint32) for r in rows]), len(cell)).astype(np.int64)
            out = [(-1, 3, 0, b"", int(c), int(k)) for c, k in zip(cell, n, strict=True)]
        elif rows:
            keys, place, (fit, em) = _add(rows, ["fit", "em"])
            context, word = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for r, at in zip(rows, place, strict=True):
                context[at], word[at] = unsqueeze(r["context"], np.uint32), unsqueeze(r["word"], np.uint32)
                out.append((r["batch"], 2, r["part"], squeeze((fit + em)[at].astype(np.int64)), 0, 0))
            cell, n = _cells(context, _level(fit), word, em)
            out += [(-1, 3, 0, b"", int(c), int(k)) for c, k in zip(cell, n, strict=True)]
        for k in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 256], strict=True), schema, strict=True)], schema=schema)

    return dealt(asked, parts, "part").groupBy("part").applyInArrow(run, ANSWER)


def learn(cells: list[tuple[int, int]], n_fit: float, types: int, p: LmParams) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) by context bucket, from (cell, held-out count) pairs, by EM."""
    def value(level: np.ndarray) -> np.ndarray:
        return np.where(level > 0, 2.0 ** ((np.maximum(level, 1) - 1 + 0.5) / 4), 0.0)

    weights = np.tile([0.4, 0.55, 0.05], (64, 1))
    weights[0] = [0.0, 0.9, 0.1]
    if not cells:
        return weights
    cell, n = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], np.float64)
    context, pair, word = value(cell >> 16), value((cell >> 8) & 255), value(cell & 255)
    context_level = cell >> 16
    parts = np.stack([np.where(context > 0, np.minimum(pair / np.maximum(context, 1), 1.0), 0.0), np.minimum(word / max(n_fit, 1.0), 1.0), np.full(len(cell), 1.0 / (types + 1))], axis=1)
    bucket = np.where(context_level > 0, np.maximum(_bucket(context, p), 1), 0)
    for _ in range(p.rounds):
        share = weights[bucket] * parts
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        new = np.stack([np.bincount(bucket, n * share[:, k], 64) for k in range(3)], axis=1) + np.array([0.0, 1e-3, 1e-3])
        new[1:, 0] += 1e-3
        new /= new.sum(1, keepdims=True)
        seen = np.bincount(bucket, n, 64) > 0
        weights[seen] = new[seen]
    return weights


def score(docs: DataFrame, params: LmParams = LmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    p = params
    stages = Stages(docs.sparkSession, "lm")
    stage = stages.write(batches(docs, p), "batches")
    size = stage.agg(F.coalesce(F.sum(F.length("vocab")), F.lit(0)).alias("v"), F.coalesce(F.sum(F.length("tok")), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    words = stages.write(_unigrams(stage, max(1, -(-int(size["v"]) // p.part_bytes))), "words")
    tokens, types = (int(x) for x in words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first())
    parts = max(1, -(-6 * int(size["t"]) // p.part_bytes))
    pairs = stages.write(_answer_bigrams(_ask_bigrams(stage, words, parts, p), parts), "pairs")
    cells = pairs.filter("kind = 3").groupBy("tokens").agg(F.sum("types")).collect()  # at most 256**3 cells by construction, some thousands in practice
    weights = learn([(int(a), int(b)) for a, b in sorted(cells)], tokens * (1 - 1 / p.em_share), types, p)
    return _score(stage, words.unionAll(pairs.filter("kind = 2")), tokens, types, weights, p)


def _score(stage: DataFrame, answers: DataFrame, tokens: int, types: int, weights: np.ndarray, p: LmParams) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answered = right.to_pylist()
        for own in left.to_pylist():
            fit, em, alone = _counts(own, answered)
            g = _bigrams(own, fit, em, alone, p)
            c = fit + em
            word, context = c[g.tok[g.at]], c[g.tok[g.at - 1]]
            pair, each = np.zeros(len(g.at), np.int64), g.fit.astype(np.int64) + g.em
            got = [unsqueeze(a["counts"], np.int64) for a in sorted((a for a in answered if a["kind"] == 2), key=lambda a: a["part"])]
            if got:
                each[g.far] = np.concatenate(got)
            pair[g.rich] = each[g.inverse]
            base = np.log10((word + 0.5) / (tokens + 0.5 * (types + 1)))
            w = weights[np.minimum(_bucket(context, p), 63)]
            model = np.log10(w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (types + 1))
            n = np.diff(g.off) - 1
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            known = np.add.reduceat((word > 0).astype(np.int64), first)
            held, _ = _roles(own["ids"], p)
            out.append(pa.Table.from_arrays([pa.array(own["ids"], pa.int64()), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(model, first))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return stage.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
