"""A corpus pipeline of five training-data operators, from raw documents to packed sequences.

Every stage works on all rows that the one before it kept: quality rules drop what they reject, near-duplicates leave one
document of each group, personal data is replaced by its kind in brackets, the mix repeats and drops passes by source
targets, and packing lays the tokens into sequences. All stages but the last return the columns of documents.
Learning (quality labels, vote patterns) uses the labels table and the stage's own input. A document that the mix takes
several times comes as several rows, and packing treats each as a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilespan.llm import mixing, packing, pii, quality, simhash
from tilespan.llm.common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.placements(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Trees, fingerprints and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
