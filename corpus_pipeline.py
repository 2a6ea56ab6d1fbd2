"""A training corpus from the documents table: STAGES in order, each over all that the one before it kept.

Every stage is judged on its own input and its result is written as Parquet, which the next one reads. Columns besides
doc_id, text, lang, source and n_chars pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillflow.llm import decontaminate, mixing, near_dedup, quality, token_blocks
from quillflow.llm.shared import unused, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and blank texts have the share of good labels as their
    probability, so they go too unless that reaches the threshold."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.drop_near_duplicates(spark, docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the mixing plan's budgets; one that several epochs take has a row for each, one without doc_id has no
    place in an epoch and goes."""
    epoch = unused(docs, "_epoch")
    return mixing.select_documents(docs, epoch=epoch).drop(epoch)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary blocks, a row for each row of the mixture."""
    return token_blocks.token_blocks(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", classify),
    ("near_dedup", near_duplicates),
    ("decontaminate", leaks),
    ("mixing", mix),
    ("token_blocks", tokens),
]

#: SQL can't express the classifier, the signatures or the tokenizer; tests/llm holds run() against plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
