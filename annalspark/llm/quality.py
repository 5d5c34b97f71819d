"""Quality classifier by importance resampling.

Two hashed n-gram generative models, one of the target text (documents labelled good) and one of the raw corpus, give
each document a log importance weight: the sum over its distinct features of the log ratio of the two models' document
frequencies.  Documents are then drawn without replacement by the Gumbel top-k trick.

* Features: word pairs, words, and the last two and three bytes of words (they carry punctuation patterns).  Pairs are
  hashed into one table of 2**`bits` buckets, the others into a second one.
* Counts are numbers of documents, so one long or repetitive document cannot dominate, and a document's own
  contribution is left out when it is scored, so that its rare words are neutral.
* Ratios are shrunk by pseudo-documents (`prior`, `pair_prior`).  Weights are truncated (Ionides 2008): a ratio above
  exp(-`dead_zone`) counts as one.  Positive evidence of common words would otherwise grow with the length of a document
  and outweigh the few words that make it toxic; README has the figures of the plain sum.
* The noise is plain Gumbel noise, so that the k documents are a draw in proportion to the weights.
* The raw model counts every document.  The target model uses at most `label_bound` labelled documents (a hash
  sample beyond that), the documented bound of the fit.

Cases: a null text is an empty one with weight 0; null ids draw their noise from the text; rows with equal id and text
get the same decision; ties at the k-th key are all kept; without usable labels every document is kept; extra columns
pass through `resample` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Stages, fresh, kth_largest, place_of

U64 = np.uint64


@dataclass(frozen=True)
class QualityParams:
    bits: int = 21
    prior: float = 2.0
    pair_prior: float = 4.0
    dead_zone: float = 1.5
    label_bound: int = 200_000
    #: A lost good document counts as much as so many accepted bad ones when k is chosen from the labels.
    loss_ratio: float = 20.0
    seed: int = 1


@dataclass
class QualityModel:
    raw: np.ndarray
    target: np.ndarray
    n_raw: int
    n_target: int
    good: np.ndarray
    params: QualityParams = field(default_factory=QualityParams)

    @cached_property
    def ratio(self) -> np.ndarray:
        """Truncated log ratio of every bucket, for documents that are (1) and are not (0) part of the target model."""
        p = self.params
        prior = np.full(len(self.raw), p.prior, np.float32)
        prior[1 << p.bits :] = p.pair_prior
        below = np.maximum(self.raw - 1, 0) * np.float32(self.n_target / max(1, self.n_raw)) + prior
        ratio = np.stack([np.log((np.maximum(self.target - own, 0) + prior) / below) for own in (0, 1)])
        return np.where(ratio < -p.dead_zone, ratio, 0)


def features(words: tv.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs of a slice; buckets from 2**bits on are those of word pairs."""
    doc = words.doc()
    size = words.end - words.start
    tail = np.zeros((2, len(size)), U64)
    for row, k in enumerate((2, 3)):
        at = np.maximum(words.end - k, words.start)
        for j in range(k):
            tail[row] = (tail[row] << U64(8)) | words.low[np.minimum(at + j, words.end - 1)].astype(U64)
        tail[row] = tv.mix(tail[row] + U64(0x51ED270B + k))
    pair = tv.chain(words.h, 2)
    same = doc[: len(pair)] == doc[1:]
    bucket = np.concatenate([words.h, *tail]) >> U64(64 - bits)
    key = tv.distinct(np.concatenate([np.tile(doc.astype(U64), 3) << U64(bits + 1) | bucket, doc[: len(pair)][same].astype(U64) << U64(bits + 1) | U64(1 << bits) | pair[same] >> U64(64 - bits)]))
    return (key >> U64(bits + 1)).astype(np.int64), (key & U64((2 << bits) - 1)).astype(np.int64)


def _labelled(labels: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of good and bad documents, at most about `bound` of them: a hash sample beyond that."""
    per = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(1)) != 1) | (F.coalesce(F.col("toxic"), F.lit(0)) != 0)).alias("bad")
    )
    n = per.count()
    if n > bound:
        per = per.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    rows = per.select(F.col("doc_id").cast("long"), "bad").toPandas()
    ids, bad = rows["doc_id"].to_numpy(np.int64), rows["bad"].to_numpy(bool)
    return np.sort(ids[~bad]), np.sort(ids[bad])


def _isin(ids: np.ndarray, sorted_ids: np.ndarray) -> np.ndarray:
    if not len(sorted_ids):
        return np.zeros(len(ids), bool)
    k = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return sorted_ids[k] == ids


def _ids(col: pa.Array) -> np.ndarray:
    """Ids as int64; null ids become one that no label has."""
    return col.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> tuple[QualityModel, np.ndarray]:
    """The two models, and the ids of documents labelled bad.  One pass over the texts."""
    spark = docs.sparkSession
    good, bad = _labelled(labels, params.label_bound)
    share = spark.sparkContext.broadcast(good)
    bits, cells = params.bits, 2 << params.bits
    blocks, width = 64, cells // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(cells, np.int32), np.zeros(cells, np.int32)
        n = n_target = 0
        for batch in batches:
            hit = _isin(_ids(batch.column(0)), share.value)
            n, n_target = n + batch.num_rows, n_target + int(hit.sum())
            for a, b, words in tv.each(batch.column(1)):
                doc, bucket = features(words, bits)
                raw += np.bincount(bucket, minlength=cells).astype(np.int32)
                if hit[a:b].any():
                    target += np.bincount(bucket[hit[a:b][doc]], minlength=cells).astype(np.int32)
        if not n:
            return
        some = np.flatnonzero(raw)
        cut = np.searchsorted(some, np.arange(blocks + 1) * width)
        for k in range(blocks):
            at = some[cut[k] : cut[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n if not k else 0], pa.int64()), pa.array([n_target if not k else 0], pa.int64())]
                + [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), raw[at], target[at])],
                names=["block", "task", "n", "n_target", "at", "raw", "target"],
            )

    def adder(out: type):
        def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw, target = np.zeros(width, np.int64), np.zeros(width, np.int64)
            n = n_target = block = task = 0
            for batch in rows:
                for r in batch.to_pylist():
                    at, block, task = np.frombuffer(r["at"], np.int32) & (width - 1), r["block"], r["task"]
                    kind = np.int64 if len(r["raw"]) > len(r["at"]) else np.int32
                    raw[at] += np.frombuffer(r["raw"], kind)
                    target[at] += np.frombuffer(r["target"], kind)
                    n, n_target = n + r["n"], n_target + r["n_target"]
            at = np.flatnonzero(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([n]), pa.array([n_target])] + [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), raw[at].astype(out), target[at].astype(out))],
                names=["block", "task", "n", "n_target", "at", "raw", "target"],
            )

        return add

    row = "block int, task int, n long, n_target long, at binary, raw binary, target binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(count, row)
    for _ in range(3):  # 64 tasks' counts at a time, so that no step reads those of all tasks
        rows = rows.withColumn("task", F.floor(F.col("task") / 64).cast("int")).groupBy("block", "task").applyInArrow(adder(np.int64), row)
    rows = rows.withColumn("task", F.lit(0)).groupBy("block", "task").applyInArrow(adder(np.float32), row).collect()  # 64 rows, 2**(bits + 1) counts as the model holds them
    raw, target = np.zeros(cells, np.float32), np.zeros(cells, np.float32)
    for r in rows:
        at = r["block"] * width + np.frombuffer(r["at"], np.int32)
        raw[at], target[at] = np.frombuffer(r["raw"], np.float32), np.frombuffer(r["target"], np.float32)
    model = QualityModel(raw, target, sum(r["n"] for r in rows), sum(r["n_target"] for r in rows), good, params)
    return model, bad


def log_weights(words: tv.Words, is_target: np.ndarray, model: QualityModel) -> np.ndarray:
    """Truncated log importance weight of each text of a slice, its own counts left out."""
    doc, bucket = features(words, model.params.bits)
    return np.bincount(doc, np.where(is_target[doc], model.ratio[1][bucket], model.ratio[0][bucket]) if is_target.any() else model.ratio[0][bucket], minlength=len(is_target))


def _gumbel(noise: np.ndarray) -> np.ndarray:
    u = (tv.mix(noise.view(U64)) >> U64(11)).astype(np.float64) / 2.0**53
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


def _noise(docs: DataFrame, seed: int):
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.col("text"))).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id")))


def weigh(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, log_weight, key (weight plus Gumbel noise) and labelled target flag of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            w, _ = _keys(batch.column(0), batch.column(1), batch.column(2), m)
            key = w + _gumbel(batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(key)], names=["doc_id", "log_weight", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), _noise(docs, model.params.seed).alias("noise")).mapInArrow(run, "doc_id long, log_weight double, key double")


def _keys(ids: pa.Array, text: pa.Array, noise: pa.Array, m: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    hit = _isin(_ids(ids), m.good)
    w = np.zeros(len(ids))
    if m.n_target:
        for a, b, words in tv.each(text):
            w[a:b] = log_weights(words, hit[a:b], m)
    return w, hit


def choose_k(weights: DataFrame, good: np.ndarray, bad: np.ndarray, loss_ratio: float) -> tuple[int, float]:
    """How many documents to draw: as many as weigh at least the threshold that serves the labelled documents best."""
    ids = weights.sparkSession.sparkContext.broadcast((good, bad))

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b = ids.value
        for batch in batches:
            at = _ids(batch.column(0))
            is_good, is_bad = _isin(at, g), _isin(at, b)
            some = is_good | is_bad
            cell = np.clip(np.floor(batch.column(1).to_numpy()[some] * 10), -10_000, 0)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(is_good[some].astype(np.int64))], names=["cell", "good"])

    cells = weights.mapInArrow(side, "cell double, good long").groupBy("cell").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).orderBy("cell").collect()
    best, threshold, lost_good, caught = 0.0, float("-inf"), 0, 0
    for r in cells:  # at most 10,001 rows
        lost_good, caught = lost_good + r["good"], caught + r["bad"]
        if r["cell"] < 0 and caught - loss_ratio * lost_good > best:
            best, threshold = caught - loss_ratio * lost_good, (r["cell"] + 1) / 10
    return weights.filter(F.col("log_weight") >= threshold).count(), threshold


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, params: QualityParams = QualityParams()) -> tuple[DataFrame, QualityModel, float]:
    """doc_id, log_weight, kept of every document; the model; the key from which documents are kept."""
    model, bad = fit(docs, labels, params)
    stages = Stages(docs.sparkSession, "quality")
    weights = stages.write(weigh(docs, model), "weights")
    if k is None:
        k, _ = choose_k(weights, model.good, bad, params.loss_ratio)
    cut = kth_largest(weights, "key", k)
    return weights.select("doc_id", "log_weight", (F.col("key") >= F.lit(cut)).alias("kept")), model, cut


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, params: QualityParams = QualityParams()) -> DataFrame:
    """The drawn documents, all their columns as they are.  Texts are neither shuffled nor stored: they are weighed again."""
    _, model, cut = select(docs, labels, k, params)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    noise, names = fresh(docs, "noise"), docs.columns
    at_id, at_text = place_of(docs, "doc_id"), place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            w, _ = _keys(batch.column(at_id), batch.column(at_text), batch.column(len(names)), m)
            key = w + _gumbel(batch.column(len(names)).to_numpy(zero_copy_only=False))
            yield batch.select(range(len(names))).filter(pa.array(key >= cut))

    return docs.withColumn(noise, _noise(docs, params.seed)).mapInArrow(run, docs.schema)
