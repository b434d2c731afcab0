"""A training corpus from ``documents``: quality rules, near duplicates, benchmark leaks, personal data, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from defectlab.llm import stages
from defectlab.llm.common import read_table, store

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("benchmark_leaks", stages.benchmark_leaks),
    ("personal_data", stages.personal_data),
    ("byte_bpe", stages.token_ids),
]

# Sequence labelling, learned spans and sub-word merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
