"""Substring deduplication: paragraph MinHash banding, exact verification, removals by component.

1. *Paragraphs.*  Planted or quoted passages rarely coincide with lines, so a text is covered by paragraphs of
   `width` words that begin at content-defined anchors: words whose shingle hash is the least among its neighbours
   within `radius`.  Equal passages have equal anchors wherever they stand; on average an anchor comes every
   2 * radius + 1 words, and further paragraphs follow end to end up to the next one.  A text shorter than the width is
   one paragraph; with fewer words than a shingle its whole sequence is one shingle.  Nothing is passed over: one word
   over and over is a paragraph like any other.
2. *Banding.*  `bands` bands of `rows` MinHash values over the five-word shingles of each paragraph.  A pair of
   similarity s meets in one paragraph with probability 1 - (1 - s**rows)**bands (0.98 at 0.8: `band_recall`); a passage
   of 50 words has three paragraphs and more, so near copies are met with a probability close to 1, equal ones always.
3. *Collisions.*  Band keys go to hash ranges in packed rows; each batch sends an entry per distinct (key, content)
   with one document and whether it knows a second one, so a passage in a third of all documents costs an entry a
   batch.  Equal content in two documents is a repeat; different contents of one key are compared exactly, by the
   Jaccard similarity of their shingles (`percent`), one after another as pivots against the members not yet joined.
4. *Components.*  Contents that are linked, or repeat, form components; the first paragraph (by document, then
   position) of each component is kept and the others are removals.  Adjoining removals of a document form a passage.

Cases: null and wordless texts have no paragraphs; very long texts are cut like others, so a task holds a slice of them
and their paragraphs; ties of the least hash make an anchor each; null ids take part as one document; repeated rows are repeats of
each other only if their ids differ; empty tables give no rows; extra columns are ignored; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import textvec as tv
from .common import Stages, dealt, fresh, place_of, text_size
from .components import components, forest
from .jaccard import _bitmap, _place
from .lm import squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted

U64 = np.uint64
NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class PassageParams:
    width: int = 16
    shingle: int = 5
    radius: int = 6
    bands: int = 4
    rows: int = 2
    percent: int = 80
    batch_bytes: int = 8 << 20
    part_bytes: int = 24 << 20
    filter_bits: int = 26
    chunk: int = 2048


def band_recall(similarity: float, p: PassageParams) -> float:
    return 1 - (1 - similarity**p.rows) ** p.bands


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every run of n values."""
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def paragraphs(words: tv.Words, p: PassageParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (number in the slice), number of words and text number of every paragraph."""
    size = np.diff(words.off)
    short = np.flatnonzero((size > 0) & (size < p.width))
    g = tv.chain(words.h, p.shingle)
    n = len(g)
    start = np.zeros(0, np.int64)
    doc = words.doc()
    if n > 0:
        x = tv.mix(g ^ U64(0xA0761D6478BD642F))
        x = np.where(doc[:n] == doc[p.shingle - 1 :], x, U64(0xFFFFFFFFFFFFFFFF))
        pad = np.full(p.radius, U64(0xFFFFFFFFFFFFFFFF))
        low = _least(np.concatenate([pad, x, pad]), 2 * p.radius + 1)
        at = np.flatnonzero((x == low) & (x != U64(0xFFFFFFFFFFFFFFFF)))
        # from one anchor to the next, further paragraphs follow end to end
        stop = np.minimum(np.append(at[1:], len(doc)), words.off[doc[at] + 1])
        more = np.maximum(-(-(stop - at) // p.width), 1)
        at = np.repeat(at, more) + p.width * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
        start = at[(at + p.width <= words.off[doc[at] + 1])]
        # a long text whose last anchor leaves too few words, or that has none, still ends with a whole paragraph
        long = np.flatnonzero(size >= p.width)
        start = np.unique(np.concatenate([start, words.off[long + 1] - p.width]))
    first = np.concatenate([start, words.off[short]])
    many = np.concatenate([np.full(len(start), p.width), size[short]])
    order = np.argsort(first, kind="stable")
    first, many = first[order].astype(np.int64), many[order].astype(np.int64)
    return first, many, doc[first] if len(first) else first


def contents(words: tv.Words, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Identity of each paragraph's word sequence, never 0."""
    c = tv.mix(words.h)
    out = np.zeros(len(first), U64)
    for j in range(int(many.max(initial=0))):
        has = many > j
        out[has] = (out[has] ^ (out[has] >> U64(31))) * U64(0x9E3779B97F4A7C15) + c[first[has] + j]
    out = tv.mix(out + many.astype(U64))
    return np.where(out == 0, U64(1), out).view(np.int64)


def band_keys(words: tv.Words, first: np.ndarray, many: np.ndarray, p: PassageParams) -> np.ndarray:
    """Band keys, one column per band."""
    keys = np.zeros((len(first), p.bands), U64)
    g = tv.chain(words.h, p.shingle)
    full, span = many == p.width, p.width - p.shingle + 1
    few, tiny = np.flatnonzero(~full & (many >= p.shingle)), np.flatnonzero(many < p.shingle)
    whole = contents(words, first[tiny], many[tiny]).view(U64)
    for b in range(p.bands):
        for r in range(p.rows):
            x = tv.mix(g ^ tv.mix(np.array([b * p.rows + r + 1], U64))[0])
            low = _least(x, span) if len(x) >= span else x[:0]
            one = np.zeros(len(first), U64)
            one[full] = low[first[full]]
            for i in few:
                one[i] = x[first[i] : first[i] + many[i] - p.shingle + 1].min()
            one[tiny] = tv.mix(whole ^ tv.mix(np.array([b * p.rows + r + 1], U64))[0])
            keys[:, b] = tv.mix(keys[:, b] * U64(3) + one)
        keys[:, b] = tv.mix(keys[:, b] + U64(b))
    return keys


def _slices(stream: Iterator[pa.RecordBatch], p: PassageParams) -> Iterator[tuple[np.ndarray, tv.Words]]:
    for batch in stream:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for a, b, words in tv.each(batch.column(1)):
            yield ids[a:b], words


def _collisions(docs: DataFrame, parts: int, p: PassageParams) -> DataFrame:
    """repeats: contents in two documents; members: different contents that share a key."""
    edge = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(U64)

    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            content, doc = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            keys = np.concatenate([x[2] for x in held])
            held.clear()
            content, at, back = np.unique(content, return_index=True, return_inverse=True)
            one = doc[at]
            two = np.zeros(len(content), bool)
            two[back[doc != one[back]]] = True
            k = keys[at].reshape(-1)
            who = np.repeat(np.arange(len(content)), p.bands)
            order = np.argsort(k)
            k, who = k[order], who[order]
            cut = [0, *np.searchsorted(k, edge), len(k)]
            for i in range(parts):
                if cut[i] < cut[i + 1]:
                    some, local = np.unique(who[cut[i] : cut[i + 1]], return_inverse=True)
                    row = (i, squeeze_sorted(k[cut[i] : cut[i + 1]]), squeeze(local.astype(np.uint32)), content[some].tobytes(), squeeze(one[some]), squeeze(two[some].astype(np.uint8)))
                    yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["part", "keys", "who", "content", "doc", "two"])

        for ids, words in _slices(stream, p):
            first, many, doc = paragraphs(words, p)
            if len(first):
                held.append((contents(words, first, many), ids[doc], band_keys(words, first, many, p)))
                size += len(words.low)
            if size > p.batch_bytes:
                yield from flush()
                size = 0
        yield from flush()

    def meet(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, content, doc, two = [], [], [], []
        for batch in stream:
            for r in batch.to_pylist():
                who = unsqueeze(r["who"], np.uint32)
                k.append(unsqueeze_sorted(r["keys"]))
                content.append(np.frombuffer(r["content"], np.int64)[who])
                doc.append(unsqueeze(r["doc"], np.int64)[who])
                two.append(unsqueeze(r["two"], np.uint8)[who] > 0)
        k, content, doc, two = (np.concatenate(x) for x in (k, content, doc, two))
        order = np.lexsort([content, k])
        k, content, doc, two = k[order], content[order], doc[order], two[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (content[1:] != content[:-1])])
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        many = np.zeros(len(start), bool)
        np.logical_or.at(many, group, two | (doc != doc[start][group]))
        content = content[start]
        repeats = np.unique(content[many])
        head = np.flatnonzero(np.concatenate([[True], k[start][1:] != k[start][:-1]]))
        end = np.append(head[1:], len(start))
        rows = sorted({content[head[i] : end[i]].tobytes() for i in np.flatnonzero(end - head > 1)})
        yield pa.RecordBatch.from_arrays([pa.array([repeats.tobytes()], pa.binary()), pa.array([None], pa.binary())], names=["repeats", "members"])
        for i in range(0, len(rows), 4096):
            some = rows[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(some), pa.binary()), pa.array(some, pa.binary())], names=["repeats", "members"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(ask, "part int, keys binary, who binary, content binary, doc binary, two binary")
    return dealt(asked, parts, "part").groupBy("part").applyInArrow(meet, "repeats binary, members binary")


def _unpack(column: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [np.frombuffer(m, np.int64) for m in batch.column(0).to_pylist()]
            size = [len(m) for m in rows]
            region = batch.column(1).to_numpy() if batch.num_columns > 1 else np.zeros(len(rows), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(region, size)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))], names=["region", column])

    return run


def _shingles(docs: DataFrame, wanted: DataFrame, p: PassageParams) -> DataFrame:
    """content, shingles of the wanted paragraphs, read again from the documents."""
    flags = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, p.filter_bits))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _slices(stream, p):
            first, many, _ = paragraphs(words, p)
            c = contents(words, first, many)
            at = _place(c, p.filter_bits)
            some = np.flatnonzero((flags.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            some = some[np.unique(c[some], return_index=True)[1]]
            g = tv.chain(words.h, p.shingle)
            sets = [tv.distinct(g[first[i] : first[i] + many[i] - p.shingle + 1]) if many[i] >= p.shingle else c[i : i + 1] for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array([x.tobytes() for x in sets], pa.binary())], names=["content", "shingles"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "content long, shingles binary")
    return found.groupBy("content").agg(F.first("shingles").alias("shingles")).join(wanted, "content", "left_semi")


def linked(ids: np.ndarray, sets: list[np.ndarray], across: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the contents whose shingle sets are similar; across: links must have one end in each part.

    Similar sets share one of their first shingles, rarest first, as so many of each are in both; only sets that do are
    compared, so that a shingle which all of them hold costs nothing where they have rarer ones.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    table, start = _padded(code, size, int(size.max()), len(held)), np.cumsum(size) - size
    own = [code[k : k + m] for k, m in zip(start, size, strict=True)]
    order = np.lexsort([code, held[code], owner])
    code = code[order]
    place = np.arange(len(code)) - np.repeat(start, size)
    first = place <= (size + (-percent * size) // 100)[owner]
    order = np.lexsort([owner[first], code[first]])
    code, owner = code[first][order], owner[first][order]  # holders of each first shingle, in order
    end = np.searchsorted(code, code, "right")
    by, at = np.argsort(owner, kind="stable"), np.arange(1, len(code) + 1)
    by = by[end[by] > at[by]]
    label = np.arange(n)
    us, vs = [], []
    for one in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1) if len(by) else []:
        i = owner[one[0]]
        other = np.unique(np.concatenate([owner[k + 1 : end[k]] for k in one]))
        other = other[label[other] != label[i]]
        if across is not None:
            other = other[across[other] != across[i]]
        if not len(other):
            continue
        both = (table[other][:, :, None] == own[i]).sum((1, 2))
        for j in other[100 * both >= percent * (size[i] + size[other] - both)]:
            if label[j] != label[i]:
                us.append(ids[i])
                vs.append(ids[j])
                label[label == label[j]] = label[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def _padded(flat: np.ndarray, size: np.ndarray, width: int, free: int = 0) -> np.ndarray:
    """A row per set, filled up with numbers from `free` on that no other row has."""
    table = np.arange(free, free + len(size) * width).astype(flat.dtype).reshape(-1, width)
    row = np.repeat(np.arange(len(size)), size)
    table[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return table


def similar(a: np.ndarray, b: np.ndarray, table: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows of a table of padded shingle sets are similar enough; padding differs from row to row."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 16_384):
        x, y = a[k : k + 16_384], b[k : k + 16_384]
        both = (table[x][:, :, None] == table[y][:, None, :]).sum((1, 2))
        out[k : k + 16_384] = 100 * both >= percent * (size[x] + size[y] - both)
    return out


def _edges(regions: DataFrame, shingles: DataFrame, p: PassageParams, small: int = 48) -> DataFrame:
    """Verified links between different contents of one region (region, content).

    Small regions share groups and their few pairs are compared at once; larger ones are walked pivot by pivot, in
    pairs of chunks beyond `chunk` members.
    """
    size = regions.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
    shared = max(1, regions.count() // 10_000)
    rows = regions.join(size, "region").withColumn("chunks", F.ceil(F.col("members") / F.lit(p.chunk)).cast("long"))
    rows = rows.withColumn("group", F.when(F.col("members") <= small, -1 - F.pmod(F.xxhash64("region"), F.lit(shared))).otherwise(F.col("region")))
    rows = rows.join(shingles, "content").withColumn("chunk", F.pmod(F.xxhash64("content"), "chunks"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("lo", F.least("chunk", "with")).withColumn("hi", F.greatest("chunk", "with"))
    width = p.width - p.shingle + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["region", "content"])
        ids, sets = pdf["content"].to_numpy(np.int64), [np.frombuffer(s, U64) for s in pdf["shingles"]]
        if pdf["group"].iloc[0] >= 0:
            across = None if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else pdf["chunk"].to_numpy()
            u, v = linked(ids, sets, across, p.percent)
            return pd.DataFrame({"u": u, "v": v})
        many = np.array([len(s) for s in sets])
        table = _padded(np.concatenate(sets), many, width)
        region = pdf["region"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        pairs = []
        for n in np.unique(np.diff(cut)):
            if n > 1:
                i, j = np.triu_indices(n, 1)
                start = cut[:-1][np.diff(cut) == n]
                pairs.append(np.stack([(start[:, None] + i).ravel(), (start[:, None] + j).ravel()]))
        if not pairs:
            return pd.DataFrame({"u": ids[:0], "v": ids[:0]})
        a, b = np.concatenate(pairs, axis=1)
        once = np.unique(np.stack([ids[a], ids[b]]), axis=1, return_index=True)[1]
        a, b = a[once], b[once]
        ok = similar(a, b, table, many, p.percent)
        u, v = forest(ids[a[ok]], ids[b[ok]])
        return pd.DataFrame({"u": u, "v": v})

    return rows.select("group", "region", "lo", "hi", "chunk", "content", "shingles").groupBy("group", "lo", "hi").applyInPandas(run, "u long, v long")


def repeated(docs: DataFrame, params: PassageParams = PassageParams()) -> DataFrame:
    """Repeated passages: doc_id, start_word, end_word, n_words, component_id, removed.

    component_id is the smallest document among the holders of the passage's first paragraph.  Of each component one
    paragraph is kept, so the first holder's passage has removed = false.
    """
    p = params
    stages = Stages(docs.sparkSession, "passages")
    _, size = text_size(docs, "text")
    met = stages.write(_collisions(docs, max(1, -(-size // p.part_bytes)), p), "met")
    repeats = met.filter("repeats is not null").select("repeats").mapInArrow(_unpack("content"), "region long, content long").select("content").distinct()
    regions = met.filter("members is not null").select("members").distinct().select("members", F.monotonically_increasing_id().alias("region"))
    regions = stages.write(regions.mapInArrow(_unpack("content"), "region long, content long"), "regions")
    wanted = stages.write(regions.select("content").distinct(), "wanted")
    shingles = stages.write(_shingles(docs, wanted, p), "shingles")
    edges = stages.write(_edges(regions, shingles, p), "edges")
    labels = components(edges, stages, "components").withColumnRenamed("node", "content")
    roots = labels.select(F.col("component").alias("content")).distinct().withColumn("component", F.col("content"))
    named = stages.write(repeats.select("content", F.col("content").alias("component")).join(labels.unionAll(roots).select("content"), "content", "left_anti").unionAll(labels.select("content", "component")).unionAll(roots), "named")
    places = stages.write(_places(docs, named, p), "places")
    stages.retain("places")
    first = places.groupBy("component").agg(F.min(F.struct("doc_id", "start_word")).alias("first"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    first = first.filter("low <> high")
    rows = places.join(first, "component").select("doc_id", "start_word", "end_word", F.col("low").alias("component_id"), ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start_word") != F.col("first.start_word"))).alias("removed"))
    run = W.partitionBy("doc_id", "removed").orderBy("start_word", "end_word", "component_id")
    reach = F.max("end_word").over(run.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start_word") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(run.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy("doc_id", "removed", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min_by("component_id", F.struct("start_word", "component_id")).alias("component_id"))
    doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return out.select(doc.alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"), "removed")


def _places(docs: DataFrame, named: DataFrame, p: PassageParams) -> DataFrame:
    """doc_id, start_word, end_word, component of every paragraph with a named content."""
    flags = docs.sparkSession.sparkContext.broadcast(_bitmap(named.select("content"), p.filter_bits))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in _slices(stream, p):
            first, many, doc = paragraphs(words, p)
            c = contents(words, first, many)
            at = _place(c, p.filter_bits)
            some = np.flatnonzero((flags.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            begin = first[some] - words.off[doc[some]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc[some]]), pa.array(begin), pa.array(begin + many[some]), pa.array(c[some])], names=["doc_id", "start_word", "end_word", "content"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, start_word long, end_word long, content long")
    return found.join(named, "content").select("doc_id", "start_word", "end_word", "component")


def remove(docs: DataFrame, params: PassageParams = PassageParams()) -> DataFrame:
    """The documents without their removed passages; other columns are as they are, but for n_chars.

    Every row is a document of its own here, also where ids repeat or are null: rows are numbered in the order of their
    ids (nulls last), so that the lowest id keeps a passage.
    """
    row = fresh(docs, "row")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    own = Stages(docs.sparkSession, "passages-rows").write(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()), "rows")
    gone = repeated(own.select(F.col(row).alias("doc_id"), "text"), params).filter("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    names, schema = docs.columns, docs.schema
    at, size = place_of(docs, "text"), next((k for k, f in enumerate(schema) if f.name.lower() == "n_chars" and f.dataType.typeName() in ("long", "integer")), None)
    spans = fresh(docs, "spans")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts, cut = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            for i, c in enumerate(cut):
                if c:
                    raw = texts[i].encode()
                    words = tv.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
                    keep = np.ones(len(raw), bool)
                    for s in c:
                        keep[words.start[s["start_word"]] : words.end[s["end_word"] - 1]] = False
                    texts[i] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, cols[at].type)
            if size is not None:
                cols[size] = pa.array([None if t is None else len(t) for t in texts], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return own.join(gone.select(F.col("doc_id").alias(row), F.col("spans").alias(spans)), row, "left").select(*names, spans).mapInArrow(run, schema)
