"""Fill-in-the-middle documents: a text's tokens are cut at two keyed places and its three parts reordered.

A text becomes a numpy array of code points; neighbouring classes (white space or not) are compared, and the places
where a word ends are the boundaries between its n tokens, so that choosing a rank is indexing an array.  The keyed
hash of the document's id gives the ranks of both cuts, the form and its order, the same on every run and in every
partition.  Nothing is shuffled.

A document stays plain when it is empty, holds one of the marks, or is not drawn (`rate`); drawn ones put the suffix
first (spm) or keep the prefix first (psm), by `spm_rate`.  As no drawn text holds a mark, `restored` finds the parts
again by the first occurrence of each mark.

Cases: a null text is an empty one; a null id is keyed as the empty string; repeated rows get equal results; empty tables
give no rows; extra columns of any name are ignored; memory grows with the longest text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts that are cut together.
TOGETHER = 512


def boundaries(points: np.ndarray) -> np.ndarray:
    """0 and the end of each token: white space and the word after it, or the white space that ends a text."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate([[0], ends, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def parts_of(text: str, low: int, high: int) -> tuple[int, tuple[str, str, str]]:
    """The number of tokens n, and prefix, middle and suffix, cut after `low` % (n + 1) and `high` % (n + 1) tokens in order."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = boundaries(points)
    n = len(ends) - 1
    a, b = sorted((int(ends[low % (n + 1)]), int(ends[high % (n + 1)])))
    return n, tuple(part.tobytes().decode("utf-32-le") for part in (points[:a], points[a:b], points[b:]))


def _one(doc_id: object, text: str, seed: int, rate: int, spm_rate: int) -> tuple:
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, (prefix, middle, suffix) = parts_of(text, h1, h2)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", prefix, middle, suffix, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", prefix, middle, suffix, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm_rate: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output); the parts are null for plain documents.  Rates are percents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                keys, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                rows = [_one(k, t or "", seed, rate, spm_rate) for k, t in zip(keys, texts, strict=True)]
                columns = [pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "form", "prefix", "middle", "suffix", "output"])

    kind = docs.select(F.col(doc_id)).schema[0].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("form", "prefix", "middle", "suffix", "output"))])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    middle = F.substring_index(output, MIDDLE, -1)
    first = F.substring_index(output, MIDDLE, 1)
    head, tail = F.substring_index(first, SUFFIX, 1), F.substring_index(first, SUFFIX, -1)
    psm = F.concat(F.substring(head, len(PREFIX) + 1, 2**31 - 1), middle, tail)
    suffix, prefix = F.substring_index(first, PREFIX, 1), F.substring_index(first, PREFIX, -1)
    spm = F.concat(prefix, middle, F.substring(suffix, len(SUFFIX) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """Documents transformed with the usual rates, and the digests of their outputs and of the texts rebuilt from them."""
    made = transform(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
