"""Quality classifier from trusted positives and unlabelled texts, by non-negative unbiased risk.

No row is known to be bad. With the class prior ``prior``, a linear score ``f`` and
the squared loss ``(1 - y f)^2 / 4``, the risk of the unseen negatives is that of all
texts taken as negatives less ``prior`` times that of the positives taken as such;
the non-negative estimate never lets this difference fall below zero:

    prior * R_positive(f, +1) + max(0, R_unlabelled(f, -1) - prior * R_positive(f, -1))

All three are quadratic in the weights, so the mean products of the features over
*all* texts and over *all* trusted positives are everything the fit needs: one pass,
no sample, and a table of a row for each pair of features for the driver. Features
are whole numbers, hence sums are exact and do not depend on the order of tasks. The
estimate is the larger of two convex functions; its least value is found by
bisection on their mixture (``non_negative_weights``).

The prior is estimated by matching the positives to a part of all texts: the ratio
of the two densities, fitted by least squares in the same features, has the mean
``1 / prior`` over the positives when good and bad texts do not overlap; the more
they do, the more the estimate errs upwards.

A text is described by how its kinds of characters follow each other, and by shares
(of signs, capitals, repeated words, doubled lines, ...) cut into ranges. NULL and
empty texts are described as such and are scored like all others; very long texts
are read whole; repeated rows get equal scores and count as often as they occur. An
id whose labels differ is not trusted. Without a trusted positive every score is
0.5. Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.llm.common import store, text_udf, to_batch

# Value of a feature that is wholly there; weights are found for features divided by it.
FULL = 255
# The ridge falls with the number of trusted positives, whose chance patterns it damps.
RIDGE = 1e-4
RIDGE_BY_POSITIVES = 2.0
STEPS = 60

KINDS = ("letter", "capital", "digit", "blank", "line end", "stop", "call", "sign", "other")
SHARES = (0.0, 0.001, 0.003, 0.01, 0.03, 0.07, 0.15, 0.3, 0.5, 0.7, 0.9, 0.98)
MEASURES = (
    "capitals", "digits", "calls", "signs", "marked words", "capital words", "letterless words", "echoes",
    "distinct words", "doubled lines", "short lines", "stops", "word length", "text length", "line length", "worst line",
)
WIDTH = 1 + len(KINDS) ** 2 + len(MEASURES) * (len(SHARES) + 1)


def _kinds() -> np.ndarray:
    """The kind of every code point below the surrogates; the rest are others."""
    table = np.full(0xD800, KINDS.index("other"), dtype=np.uint8)
    for i in range(0xD800):
        c = chr(i)
        if c in "\n\r\x0b\x0c\x85  ":
            kind = "line end"
        elif c.isspace():
            kind = "blank"
        elif c.isupper():
            kind = "capital"
        elif c.isalpha():
            kind = "letter"
        elif c.isdigit():
            kind = "digit"
        elif c in ".,;:'\"()-–—‘’“”":
            kind = "stop"
        elif c in "!?¡¿":
            kind = "call"
        elif i < 0x300:
            kind = "sign"
        else:
            continue
        table[i] = KINDS.index(kind)
    return table


_TABLE: list[np.ndarray] = []


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def describe(text: str) -> np.ndarray:
    """The features of a whole text, each from 0 to ``FULL``."""
    if not _TABLE:
        _TABLE.append(_kinds())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.where(points < 0xD800, _TABLE[0][np.minimum(points, 0xD7FF)], KINDS.index("other")).astype(np.int64)
    k, n = len(KINDS), len(kinds)
    follow = np.bincount(kinds[:-1] * k + kinds[1:], minlength=k * k) if n > 1 else np.zeros(k * k)
    many = np.bincount(kinds, minlength=k)
    letter, capital, digit, _, _, stop, call, sign, _ = many.tolist()
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:'\")" for w in words)
    bad = [sum(not w[-1].isalnum() and w[-1] not in ".,;:'\")" for w in own) / len(own) for own in map(str.split, lines) if len(own) > 4]
    shown = n - many[3] - many[4]
    values = (
        _share(capital, letter + capital),
        _share(digit, shown),
        _share(call, shown),
        _share(sign, shown),
        _share(marked, len(words)),
        _share(sum(len(w) > 1 and w.isupper() for w in words), len(words)),
        _share(sum(not any(map(str.isalpha, w)) for w in words), len(words)),
        _share(sum(map(str.__eq__, words[1:], words)), len(words)),
        _share(len(set(words)), len(words)),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(sum(len(line) < 40 for line in lines), len(lines)),
        _share(stop, shown),
        min(1.0, _share(shown, len(words)) / 20),
        min(1.0, math.log1p(len(words)) / 12),
        min(1.0, math.log1p(_share(n, len(lines))) / 12),
        max(bad, default=0.0),
    )
    found = np.zeros(WIDTH, dtype=np.uint8)
    found[0] = FULL
    found[1 : 1 + k * k] = np.rint(FULL * np.sqrt(follow / max(1, n - 1)))
    cuts = 1 + k * k + np.arange(len(values)) * (len(SHARES) + 1)
    found[cuts + np.searchsorted(SHARES, values)] = FULL
    return found


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``features`` of every row, written once for the fit and the scores."""

    def start():
        return lambda values: [(describe(v or "").tobytes(),) for v in values]

    features = text_udf("struct<features:binary>", start)(F.col(text))
    return store(docs.select("doc_id", features["features"].alias("features")), "described")


class Sums(NamedTuple):
    """Mean products of the features over all texts and over the trusted positives, which are how many."""

    all_: np.ndarray
    positive: np.ndarray
    n_all: int
    n_positive: int


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed products of all pairs of features that occur together; float sums of whole numbers are exact here."""
    sums = np.zeros((2, WIDTH, WIDTH))
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            rows = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.float64)
            trusted = rows[np.array(part.column(1).to_pylist(), dtype=bool)]
            sums[0] += rows.T @ rows
            sums[1] += trusted.T @ trusted
    i, j = np.nonzero(np.triu(sums[0]))
    yield to_batch([i, j, sums[0][i, j].astype(np.int64), sums[1][i, j].astype(np.int64)], "i int,j int,u long,p long")


def sums_of(found: DataFrame, trusted: DataFrame) -> Sums:
    """From ``described`` rows and the ids (``doc_id``, each once) that are trusted to be good."""
    marked = found.join(trusted.select("doc_id", F.lit(True).alias("trusted")), "doc_id", "left")
    rows = marked.select("features", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(_products, "i int, j int, u long, p long")
    u, p = np.zeros((WIDTH, WIDTH)), np.zeros((WIDTH, WIDTH))
    for r in rows.groupBy("i", "j").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect():  # at most WIDTH * WIDTH rows
        u[r["i"], r["j"]] = u[r["j"], r["i"]] = r["u"]
        p[r["i"], r["j"]] = p[r["j"], r["i"]] = r["p"]
    n_all, n_positive = (round(a[0, 0] / FULL**2) for a in (u, p))
    return Sums(u / FULL**2 / max(1, n_all), p / FULL**2 / max(1, n_positive), n_all, n_positive)


def _ridge(sums: Sums) -> np.ndarray:
    """Next to nothing for the constant feature."""
    scale = RIDGE + RIDGE_BY_POSITIVES / max(1, sums.n_positive)
    return np.diag(np.where(np.arange(WIDTH) == 0, 1e-3, 1.0) * scale)


def estimated_prior(sums: Sums) -> float:
    """The share of good texts, from how well a part of all texts matches the positives."""
    mean = sums.positive[0]
    ratio = np.linalg.solve(sums.all_ + _ridge(sums), mean)
    return float(min(0.99, max(0.01, 1 / max(1.0, mean @ ratio))))


def risks(sums: Sums, prior: float, weights: np.ndarray) -> tuple[float, float]:
    """The positives' part of the risk and the negatives' part before it is kept from falling below zero."""
    p, u = sums.positive[0] @ weights, sums.all_[0] @ weights
    pp, uu = weights @ sums.positive @ weights, weights @ sums.all_ @ weights
    return prior * (1 - 2 * p + pp) / 4, (1 + 2 * u + uu) / 4 - prior * (1 + 2 * p + pp) / 4


def non_negative_weights(sums: Sums, prior: float) -> np.ndarray:
    """The weights of least non-negative risk with a small ridge.

    The risk is ``max(0 <= s <= 1) positives + s * negatives``, convex in the weights
    for every ``s``, so its least value is the greatest, over ``s``, of the least
    value for that ``s``. There the negatives' part is zero, unless ``s`` is 1.
    """
    p, u = sums.positive[0], sums.all_[0]

    def best(s: float) -> np.ndarray:
        return np.linalg.solve((1 - s) * prior * sums.positive + s * sums.all_ + _ridge(sums), (1 + s) * prior * p - s * u)

    weights = best(1.0)
    if risks(sums, prior, weights)[1] >= 0:
        return weights
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        s = (low + high) / 2
        weights = best(s)
        if risks(sums, prior, weights)[1] >= 0:
            low = s
        else:
            high = s
    return best(low)


class Model(NamedTuple):
    weights: np.ndarray
    prior: float


def fit(found: DataFrame, labels: DataFrame, trains: Column, label: str = "quality") -> Model:
    """From ``described`` rows and the labels of the rows for which ``trains`` holds; of these only the good ones are used."""
    told = labels.where(trains & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    sums = sums_of(found, told.groupBy("doc_id").agg(F.min(label).alias("worst")).where("worst = 1").select("doc_id"))
    if not sums.n_positive:
        return Model(np.zeros(WIDTH), 0.5)
    prior = estimated_prior(sums)
    return Model(non_negative_weights(sums, prior), prior)


def score(features: Column, model: Model) -> Column:
    """From 0 to 1, 0.5 where good and bad are equally likely."""
    weights = model.weights / FULL

    def run(values: list) -> list[tuple]:
        rows = np.frombuffer(b"".join(values), np.uint8).reshape(-1, WIDTH).astype(np.float64)
        # A row by itself, so that equal rows get equal scores wherever they stand.
        return [(1 / (1 + math.exp(-2 * float(v))),) for v in (rows * weights).sum(axis=1)]

    return text_udf("struct<score:double>", lambda: run)(features)["score"]
