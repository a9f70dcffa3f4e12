"""The corpus pipeline: STAGES over documents, each stage's rows written and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.  A stage's docs are what its predecessor's rows were written to, so it first deletes
the scratch tables that earlier stages left, unless its docs still read them (stages called one on another without writing).
Empty tables stay empty, repeated rows are each judged, texts count whole, and columns beyond those of documents
ride along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_unread, left_marks, left_since, materialize
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard import deduplicate
from tidemark.llm.mixing import mix
from tidemark.llm.pii import redact
from tidemark.llm.quality import quality_filter

_left: list[DataFrame] = []


def _staged(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator's rows, after the scratch tables of stages before it."""
    _left[:] = drop_unread(_left, docs)
    mark = left_marks()
    out = operator(docs)
    _left.extend(left_since(mark))
    return out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; null and empty texts go."""
    return _staged(docs, quality_filter)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.75) the row with the least doc_id; all without one stay."""
    return _staged(docs, deduplicate)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no ten-word window with a benchmark item; null texts share none."""
    return _staged(docs, lambda d: decontaminate(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in texts replaced by its kind; n_chars follows the text, and stays where that is null."""
    kind = docs.schema["n_chars"].dataType
    return _staged(docs, redact).withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each copy taken (column copy)."""
    return _staged(docs, mix)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("source_mix", mixing_stage),
]

#: Prefix trees and adaptive sketches have no SQL twin; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
