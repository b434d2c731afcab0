"""Features, sums over all rows, the least non-negative risk, the prior, held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlab.llm import pu_quality as q
from defectlab.llm.toxicity import held_out

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return q.described(docs), labels


def made(seed, n=4000, n_positive=600, prior=0.7):
    """Sums of texts whose features are drawn: good and bad ones differ in some and overlap."""
    rng = np.random.default_rng(seed)

    def draw(n, good):
        rows = np.zeros((n, q.WIDTH))
        rows[:, 0] = 1
        rows[:, 1:6] = rng.random((n, 5)) < (0.8 if good else 0.15)
        rows[:, 6:20] = rng.random((n, 14)) < 0.5
        return rows

    good, bad = draw(round(n * prior), True), draw(n - round(n * prior), False)
    all_, positive = np.concatenate([good, bad]), draw(n_positive, True)
    return q.Sums(all_.T @ all_ / n, positive.T @ positive / n_positive, n, n_positive), all_, positive, good, bad


def risk(all_, positive, prior, weights):
    """The estimate row by row, without the sums."""
    loss = lambda rows, y: ((1 - y * (rows @ weights)) ** 2 / 4).mean()
    return prior * loss(positive, 1), loss(all_, -1) - prior * loss(positive, -1)


def test_risk_from_sums_equals_rows():
    sums, all_, positive, _, _ = made(1)
    rng = np.random.default_rng(0)
    for _ in range(5):
        weights = rng.normal(size=q.WIDTH) / 5
        assert np.allclose(q.risks(sums, 0.6, weights), risk(all_, positive, 0.6, weights))


@pytest.mark.parametrize("prior", [0.3, 0.7, 0.9, 0.97])
def test_least_non_negative_risk(prior):
    """No step from the weights found lowers the objective, whichever part of it holds."""
    sums, all_, positive, _, _ = made(2)
    ridge = np.diag(q._ridge(sums))

    def objective(w):
        good, bad = risk(all_, positive, prior, w)
        return good + max(0.0, bad) + (ridge * w * w).sum() / 4

    weights = q.non_negative_weights(sums, prior)
    least, rng = objective(weights), np.random.default_rng(3)
    assert q.risks(sums, prior, weights)[1] >= -1e-9
    for size in (1e-1, 1e-2, 1e-3):
        for _ in range(200):
            step = rng.normal(size=q.WIDTH) * (np.diag(sums.all_) > 0)
            assert objective(weights + size * step / np.linalg.norm(step)) >= least - 1e-10
    if prior == 0.97:  # more good texts than there are: without the correction the difference would be below zero
        assert q.risks(sums, prior, np.linalg.solve(sums.all_ + np.diag(ridge), 2 * prior * sums.positive[0] - sums.all_[0]))[1] < -1e-4
        assert abs(q.risks(sums, prior, weights)[1]) < 1e-6


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_and_classes(prior):
    """Without a known negative nearly as good as the same loss fitted with all labels."""
    sums, _, _, good, bad = made(4, prior=prior)
    found = q.estimated_prior(sums)
    assert abs(found - prior) < 0.12
    told = prior * good.mean(axis=0) - (1 - prior) * bad.mean(axis=0)
    with_labels = np.linalg.solve(sums.all_ + q._ridge(sums), told)

    def accuracy(w):
        return prior * (good @ w >= 0).mean() + (1 - prior) * (bad @ w < 0).mean()

    def order(w):
        a, b = good @ w, bad @ w
        return (a[:, None] > b).mean() + (a[:, None] == b).mean() / 2

    assert accuracy(q.non_negative_weights(sums, prior)) > accuracy(with_labels) - 0.05
    weights = q.non_negative_weights(sums, found)  # the estimate errs upwards, which moves the cut but not the order
    assert order(weights) > order(with_labels) - 0.02 and order(weights) > 0.9
    assert accuracy(weights) >= max(prior, 1 - prior) - 0.02


def test_sums_cover_all_rows(spark, tables):
    found, _ = tables
    trusted = found.where("doc_id % 3 = 0").select("doc_id").distinct()
    rows = found.collect()
    all_ = np.stack([np.frombuffer(r["features"], np.uint8) for r in rows]).astype(np.float64) / q.FULL
    own = all_[[r["doc_id"] % 3 == 0 for r in rows]]
    sums = q.sums_of(found.repartition(7), trusted)
    assert (sums.n_all, sums.n_positive) == (len(all_), len(own))
    assert np.allclose(sums.all_, all_.T @ all_ / len(all_)) and np.allclose(sums.positive, own.T @ own / len(own))


def test_held_out_accuracy(tables):
    found, labels = tables
    model = q.fit(found, labels, ~held_out(F.col("doc_id")))
    told = found.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("quality", q.score(F.col("features"), model).alias("s")).collect()
    good, bad = [r["s"] for r in told if r["quality"]], [r["s"] for r in told if not r["quality"]]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.97
    assert sum(g >= 0.5 for g in good) > 0.95 * len(good) and sum(b < 0.5 for b in bad) > 0.85 * len(bad)
    share = labels.agg(F.avg("quality")).first()[0]
    assert abs(model.prior - share) < 0.12


def test_only_good_labels_that_are_not_held_out_are_read(tables):
    found, labels = tables
    trains = ~held_out(F.col("doc_id"))
    changed = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.fit(found, labels, trains), q.fit(found, changed.where("quality = 1 OR doc_id % 2 = 0"), trains)
    assert a.prior == b.prior and (a.weights == b.weights).all()


def test_equal_rows_whatever_the_partitions(spark, tables):
    found, labels = tables
    a, b = (q.fit(found.repartition(n), labels, ~held_out(F.col("doc_id"))) for n in (1, 9))
    assert a.prior == b.prior and (a.weights == b.weights).all()


def test_describe():
    at = {m: 1 + len(q.KINDS) ** 2 + i * (len(q.SHARES) + 1) for i, m in enumerate(q.MEASURES)}

    def share(text, measure):
        return int(np.argmax(q.describe(text)[at[measure] : at[measure] + len(q.SHARES) + 1]))

    assert share("AB CD", "capitals") > share("Ab cd ef gh", "capitals") > share("ab", "capitals") == 0
    assert share("x x x x", "echoes") > share("x y x y", "echoes") == 0
    assert share("a\na\na", "doubled lines") > share("a\nb", "doubled lines")
    for text in ("", " \n", "x", "日本🙂", "a" * 100_000):
        row = q.describe(text)
        assert len(row) == q.WIDTH and row[0] == q.FULL
        assert row[1 + len(q.KINDS) ** 2 :].sum() == q.FULL * len(q.MEASURES)  # one range of each measure


def test_odd_rows(spark, odd_docs, no_docs, tables):
    found = q.described(odd_docs)
    for labels in (tables[1], tables[1].limit(0), spark.createDataFrame([(None, 1), (4, None), (4, 1), (5, 1), (5, 0)], "doc_id long, quality int")):
        model = q.fit(found, labels, F.lit(True))
        rows = found.select("doc_id", q.score(F.col("features"), model).alias("s")).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r["s"] <= 1 for r in rows)
        assert len({r["s"] for r in rows if r["doc_id"] == 4}) == 1
        if labels.where("quality = 1 AND doc_id IS NOT NULL").count() == 0:
            assert {r["s"] for r in rows} == {0.5}
    empty = q.described(no_docs)
    assert empty.select(q.score(F.col("features"), q.fit(empty, tables[1], F.lit(True))).alias("s")).collect() == []
