"""Closeness to any number of keywords against all pairs; tags by occurrence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlab.operators import relevance as rel
from defectlab.plans import skew


def _vectors(spark, n, dim, seed):
    rows = np.random.default_rng(seed).normal(size=(n, dim)) * np.random.default_rng(seed + 1).uniform(0.1, 9, (n, 1))
    return rows, spark.createDataFrame([(f"t{i}", [float(x) for x in r]) for i, r in enumerate(rows)], "token string, vector array<double>")


@pytest.mark.parametrize(("block", "at_once"), [(1 << 24, 256), (400, 4), (4000, 7)])
@pytest.mark.parametrize("cutoff", [0.8, 0.3, -0.2])
def test_equals_all_pairs(spark, block, at_once, cutoff):
    rows, vectors = _vectors(spark, 150, 5, 3)
    keys, keywords = _vectors(spark, 60, 5, 9)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    want = {f"t{i}" for i in np.flatnonzero((unit(rows) @ unit(keys).T >= cutoff).any(axis=1))}
    found = [r["token"] for r in rel.close_tokens(vectors, keywords.select("vector"), cutoff, block, at_once).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_five_thousand_keywords(spark):
    rows, vectors = _vectors(spark, 300, 16, 5)
    keys, keywords = _vectors(spark, 5000, 16, 6)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    want = {f"t{i}" for i in np.flatnonzero((unit(rows) @ unit(keys).T >= 0.75).any(axis=1))}
    assert {r["token"] for r in rel.close_tokens(vectors, keywords.select("vector"), 0.75, 100_000).collect()} == want


def test_odd_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("null", None), ("a", [1.0, 0.0])], "token string, vector array<double>")
    for keys, want in (([[2.0, 0.0]], {"a"}), ([[0.0, 0.0]], set()), ([[0.0, 0.0], [9.0, 0.1], None], {"a"}), ([], set())):
        keywords = spark.createDataFrame([(k,) for k in keys], "vector array<double>")
        assert {r["token"] for r in rel.close_tokens(vectors, keywords, 0.8).collect()} == want


def test_one_word_tagged_two_ways(spark, monkeypatch):
    tokens = spark.createDataFrame(
        [(1, "c1", "fix", "NOUN"), (1, "c2", "fix", "ADJ"), (2, "c3", "other", "VERB"), (2, "c4", "fix", "ADJ"), (2, "c4", "fix", "VERB"), (2, "c5", "fix", None)],
        "project_id long, commit_id string, token string, tag string",
    )
    vectors = spark.createDataFrame([("fix", [1.0, 0.1]), ("other", [0.0, 1.0])], "token string, vector array<double>")
    keywords = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")
    found = {tuple(r) for r in rel.tagged_matches(tokens, vectors, keywords).collect()}
    assert found == {(1, "c1"), (2, "c4")}
    monkeypatch.setattr(skew, "SMALL_ROWS", -1)
    assert {tuple(r) for r in rel.tagged_matches(tokens, vectors, keywords).collect()} == found
    assert rel.tagged_matches(tokens.withColumn("tag", F.lit("X")), vectors, keywords).count() == 0
