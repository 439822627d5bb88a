"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
its result is written and read again. All but the last return the columns of
documents; the last returns the mix, with the copies of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, mixing, neardup, pii, quality
from tidewatch.llm.common import Scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier finds likelier bad than good."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return neardup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold eight consecutive words of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with copies and taken words."""
    return mixing.take(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("benchmark_decontamination", drop_benchmark),
    ("pii", mask_private),
    ("mixing", mix_sources),
]

#: Models and random rounding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
