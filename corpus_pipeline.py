"""A training corpus from documents: quality, near duplicates, benchmark passages, personal data
and the mix of sources, each stage on what the one before it kept.

What the stages do with odd rows follows their operators: null and empty texts fail the quality
rules; rows that share an id are judged by their own texts there and against the benchmark, and stay
or go together among near duplicates; equal rows become one among near duplicates; whole texts are
read, however long; empty tables give an empty corpus, no labels and no benchmark reject nothing by
themselves; all columns pass through, whatever their names, but for ``copy``, which the last stage sets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, mixing, ngram_join, pii, quality
from foliospark.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null, empty and short texts, and those that break the rules that the
    labelled holdout of their language allows. Repeated rows go or stay alike."""
    return quality.passed(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest doc_id, and one
    of repeated rows. Null and empty texts are groups of their own, rows without an id stay."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever their id; null texts hold none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes the name of its kind; every row stays, null texts too."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks; ``copy`` counts from 1. Null sources are
    one source; rows of one id and source are emitted alike; sources without words give nothing."""
    return mixing.emit(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_redaction),
    ("mixing sources to target weights", source_mix),
]

#: Edit-distance search in the third stage has no SQL; a brute-force run is the test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet in the shared
    folder and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
