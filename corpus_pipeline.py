"""The corpus pipeline: quality rules, quality classifier, line deduplication, SimHash near-deduplication, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the last return the
columns of documents, whatever further columns docs have. Each result is written as Parquet and read again as the next stage's docs; no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxmill.llm import line_dedup, packing, quality_rules, simhash, weak_labels
from voxmill.llm.common import remove, work_path


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the base rules and lie within their language's and source's estimate. Null and empty texts go; null languages and sources are groups of
    their own; a very long text is judged by its whole length; equal rows share a verdict."""
    return quality_rules.keep_good(docs)


def _quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the scorer calls good; a text without words is scored as empty. Whether a row stays depends on its text alone, so repeated rows stay or go together."""
    return weak_labels.keep_good(docs)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat or resemble an earlier one. A null text stays null, a text may become empty; n_chars follows. Lines are those of \\n."""
    return line_dedup.dedup_lines(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row by doc_id of each group of near copies; of exact repeats one. Null, empty and wordless texts share a fingerprint, so one of them stays; null ids come last."""
    return simhash.keep_first(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows of docs in batches, by tokens; a null or empty text has one window of length 0, and rows that repeat have theirs each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", _quality_rules),
    ("quality classifier", _quality_classifier),
    ("line dedup", _line_dedup),
    ("SimHash near-dedup", _near_dedup),
    ("packing", _packing),
]

#: SQL can't express the covariance fit, the trained scorer or union-find; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's result is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
