"""A training-corpus pipeline: quality resampling, near-duplicate removal, decontamination, privacy, packing.

Each stage is an operator of `annalspark.llm` with the parameters of production; all but the last return the columns
of `documents`.  Nulls, empty tables and extra columns behave as the operators' modules state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annalspark.llm import decontaminate, jaccard, packing, pii, quality
from annalspark.llm.common import Stages
from annalspark.runtime import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampler draws."""
    return quality.resample(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    ship(spark)
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked."""
    ship(spark)
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, cached=60_000)  # workers of the earlier stages still hold memory


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", privacy_stage),
    ("best-fit packing", packing_stage),
]

#: Model-based stages have no SQL form; `tests/llm/test_pipeline.py` checks what each stage keeps on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    tables = Stages(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = tables.write(docs, f"stage-{i}")
    return docs
