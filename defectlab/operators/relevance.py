"""Selecting commits by the words of their titles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectlab.functions.text import terms
from defectlab.plans.skew import bounded_rows, skew_join, small_enough
from defectlab.session import cut_lineage

# The words that mark a commit as defect- or security-related.
KEYWORDS = (
    "fix", "bug", "bugfix", "error", "secure", "security", "maintain", "maintenance",
    "refactor", "crash", "leak", "attack", "authenticate", "authentication",
    "authorize", "authorization", "cipher", "crack", "decrypt", "encrypt",
    "vulnerable", "vulnerability", "minimize", "optimize",
)
CONTENT_TAGS = ("NOUN", "VERB")
SMALL_VOCABULARY = 50_000
KEYWORD_BYTES = 16 << 20


def title_matches(df: DataFrame, title: str = "title", keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Rows whose title holds one of the keywords as a whole word."""
    wanted = F.array(*[F.lit(k.lower()) for k in keywords])
    return df.where(F.arrays_overlap(terms(F.col(title)), wanted))


def similar_tokens(
    vectors: DataFrame,
    keywords: Sequence[Sequence[float]],
    cutoff: float = 0.8,
    tags: Sequence[str] = CONTENT_TAGS,
) -> DataFrame:
    """Tokens of the given tags whose vector points the same way as any keyword's.

    Closeness is the cosine; vectors need not have unit length, and a zero
    vector is close to nothing. All inner products of an Arrow batch are one
    matrix product.
    """
    table = _unit(np.asarray(keywords, dtype="float64")).T

    @F.pandas_udf(T.BooleanType())
    def close(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=bool)
        found = _unit(np.stack(batch.to_numpy()).astype("float64")) @ table
        return pd.Series((found >= cutoff).any(axis=1))

    tagged = vectors.where(F.col("pos").isin(*tags) & F.col("vector").isNotNull())
    return tagged.where(close("vector")).select("token").distinct()


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row becomes NaN, which passes no comparison."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def semantic_matches(
    commits: DataFrame,
    vectors: DataFrame,
    keywords: Sequence[Sequence[float]],
    cutoff: float = 0.8,
    tags: Sequence[str] = CONTENT_TAGS,
    key: Sequence[str] = ("project_id", "commit_id"),
    title: str = "title",
) -> DataFrame:
    """Commits with at least one title token close to a keyword.

    Closeness is worked out once per vocabulary entry, not per occurrence.
    When few tokens are close, occurrences are filtered in place by a broadcast
    of them; otherwise both are joined with hot tokens split up.
    """
    near = similar_tokens(vectors, keywords, cutoff, tags)
    few = bounded_rows(near, SMALL_VOCABULARY)
    if few is not None:
        spark = commits.sparkSession
        names = spark.createDataFrame(few, near.schema) if few else near.limit(0)
        hits = _occurrences(commits, key, title).join(F.broadcast(names), "token", "left_semi")
    else:
        hits = skew_join(_occurrences(commits, key, title), near, ["token"], "left_semi", list(key))
    chosen = hits.select(*key).distinct()
    return skew_join(commits, chosen, list(key), "left_semi", [title])


def close_tokens(
    vectors: DataFrame, keywords: DataFrame, cutoff: float = 0.8, block_bytes: int = KEYWORD_BYTES, at_once: int = 256
) -> DataFrame:
    """Tokens (``token``, ``vector``) with a cosine of ``cutoff`` or more to any of the ``keywords`` (``vector``).

    Any number of keywords: they are put in order of their angle to a pivot, and a
    vector can only be close to those whose angle differs from its own by no more
    than the angle of ``cutoff``. Keywords go to the tasks in ranges of that angle
    of at most about ``block_bytes``, each to the vectors in reach of it only.
    Vectors without length, or NULL, are close to nothing.
    """
    known = keywords.where(F.col("vector").isNotNull()).select(F.col("vector").cast("array<double>").alias("vector"))
    first = known.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("vector"), "vector").limit(1).collect()
    named = vectors.where(F.col("vector").isNotNull()).select("token", F.col("vector").cast("array<double>").alias("vector"))
    if not first:
        return named.select("token").limit(0)
    pivot = _unit(np.array([first[0]["vector"]]))[0]
    angled = cut_lineage(known.withColumn("angle", _angle(pivot)("vector")).where(~F.isnan("angle")))
    rows = angled.count()
    blocks = max(1, -(-rows * len(pivot) * 8 // block_bytes))
    marks = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(angled.agg(F.percentile_approx("angle", marks, 20 * blocks)).first()[0])) if marks else []
    reach = float(np.arccos(np.clip(cutoff, -1, 1))) + 1e-9
    placed = cut_lineage(named.withColumn("angle", _angle(pivot)("vector")).where(~F.isnan("angle"))) if cuts else named.withColumn("angle", _angle(pivot)("vector"))
    found = None
    for low, high in zip([-1.0, *cuts], [*cuts, 4.0], strict=True):
        held = angled.where((F.col("angle") > low) & (F.col("angle") <= high)).orderBy("angle").collect()
        if held:
            table = _unit(np.array([r["vector"] for r in held])), np.array([r["angle"] for r in held])
            reached = placed.where((F.col("angle") >= held[0]["angle"] - reach) & (F.col("angle") <= held[-1]["angle"] + reach))
            near = reached.where(_any_close(*table, cutoff, reach, at_once)("vector", "angle")).select("token")
            found = near if found is None else found.unionByName(near)
    return found.distinct()


def _angle(pivot: np.ndarray):
    @F.pandas_udf(T.DoubleType())
    def angle(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=float)
        return pd.Series(np.arccos(np.clip(_unit(np.stack(batch.to_numpy()).astype("float64")) @ pivot, -1, 1)))

    return angle


def _any_close(units: np.ndarray, angles: np.ndarray, cutoff: float, reach: float, at_once: int):
    """Matrix products of vectors with the keywords in reach of them, some keywords at a time."""

    @F.pandas_udf(T.BooleanType())
    def close(batch: pd.Series, own: pd.Series) -> pd.Series:
        found, angle = np.zeros(len(batch), dtype=bool), own.to_numpy()
        if len(batch):
            rows = _unit(np.stack(batch.to_numpy()).astype("float64"))
            for i in range(0, len(units), at_once):
                part = angles[i : i + at_once]
                left = np.flatnonzero(~found & (angle >= part[0] - reach) & (angle <= part[-1] + reach))
                found[left] = (rows[left] @ units[i : i + at_once].T >= cutoff).any(axis=1)
        return pd.Series(found)

    return close


def tagged_matches(
    tokens: DataFrame,
    vectors: DataFrame,
    keywords: DataFrame,
    cutoff: float = 0.8,
    tags: Sequence[str] = CONTENT_TAGS,
    key: Sequence[str] = ("project_id", "commit_id"),
) -> DataFrame:
    """Commits in whose title a word that is used as one of ``tags`` is close to a keyword.

    ``tokens`` has a row for each occurrence: ``key``, ``token`` and the ``tag`` of
    this occurrence, so that one word may count in one title and not in another.
    ``vectors`` has each token once. Only words in use as such are compared.
    """
    used = tokens.where(F.col("tag").isin(*tags)).select(*key, "token")
    near = cut_lineage(close_tokens(vectors, keywords, cutoff))
    if small_enough(near, ["token"]):
        return used.join(F.broadcast(near), "token", "left_semi").select(*key).distinct()
    return skew_join(used, near, ["token"], "left_semi", list(key)).select(*key).distinct()


def _occurrences(commits: DataFrame, key: Sequence[str], title: str) -> DataFrame:
    return commits.select(*key, F.explode(F.array_distinct(terms(F.col(title)))).alias("token"))
