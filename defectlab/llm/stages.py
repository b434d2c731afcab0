"""The stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``.

All but the last return the columns of ``docs``. Rows with NULLs, empty texts,
repeated rows and other columns pass through as each operator defines it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlab.llm import bpe, decontaminate, ngram_join, pii, quality
from defectlab.llm.common import BROADCAST_BYTES, read_table, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and consist of content, as the line chain sees it."""
    model = quality.fit_lines(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(quality.verdict(F.col("text"), model)["kept"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Five-word shingles, similarity 0.8. Where ids are NULL or repeat, rows are
    numbered first, so that exactly one row of a group stays.
    """
    repeated = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        return _without(docs, _dropped(docs, "doc_id"), "doc_id")
    row = f"row_{uuid.uuid4().hex}"
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    return _without(numbered, _dropped(numbered, row), row).drop(row)


def _dropped(docs: DataFrame, key: str) -> DataFrame:
    found = ngram_join.link_components(docs, n=5, percent=80, key=key)
    return store(found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)), "dropped")


def _without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    few = dropped.count() * 16 <= BROADCAST_BYTES
    return docs.join(F.broadcast(dropped) if few else dropped, key, "left_anti").select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, neither copied nor edited."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows the text."""
    kept = docs.withColumn("text", pii.redact(F.col("text"), pii.fit_spans(docs)))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: what is left, with ids of the whole texts and the bytes they decode to; columns of these names are replaced."""
    docs = docs.drop("ids", "decoded")
    found = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("_ids", "ids").withColumnRenamed("_decoded", "decoded")
