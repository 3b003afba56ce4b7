"""Corpus pipeline: from raw documents to training sequences.

Every stage takes the whole result of the one before it and returns the columns
of ``documents``; the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attrition.llm import exact_dedup, jaccard_join, mixing, pieces, quality_rules
from attrition.llm.common import new_path, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a rule learned from ``labels`` reject go."""
    return quality_rules.keep_good(docs, quality_rules.learn_rules(docs, read_table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice."""
    return mixing.mix(docs).drop("mix_shard")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document, with the scores of its N best segmentations."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode_stage),
]

ORACLE_SQL = None  # learned rules, random draws and segmentations are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared
    folder and read again, so that a lost executor never repeats an earlier one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
