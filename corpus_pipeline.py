"""The corpus pipeline: documents that are rejected, near copies and contaminated documents go; the rest is packed.

Each stage works on all that the one before kept and is written as Parquet before the next reads it.
Counts and statistics of a stage are those of its own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from headrace.llm import decontaminate, jaccard, packing, quality
from headrace.llm.common import find_code, small_batches, stored, table


#: Words that a Python worker remembers here: the executor still holds the heap that the stages before have grown.
REMEMBERED = 100_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; the trees learn from ``labels``."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id."""
    return jaccard.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in packed sequences."""
    find_code(spark)
    return packing.packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)


STAGES = [(f.__name__, f) for f in (quality_classifier, ngram_jaccard_join, benchmark_decontamination, best_fit_packing)]
#: Trained scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
