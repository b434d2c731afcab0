import random

import pytest

from defectlab.operators import metrics as mt
from defectlab.operators import runs as rn
from defectlab.plans import ranks


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label int, score double")


def judged(spark, pairs):
    return spark.createDataFrame(pairs, "label int, prediction int")


def brute_auc(labels, scores):
    pos = [s for t, s in zip(labels, scores) if t == 1]
    neg = [s for t, s in zip(labels, scores) if t == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_and_average_precision(spark):
    row = mt.ranking_metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])).first()
    assert row.auc == 0.75
    assert row.average_precision == pytest.approx(0.8333333333)


def test_auc_of_equal_scores_and_of_one_class(spark):
    assert mt.roc_auc(scored(spark, [0, 1, 1], [0.5] * 3)).first().auc == 0.5
    assert mt.roc_auc(scored(spark, [1, 1], [0.1, 0.2])).first().auc is None
    none = mt.ranking_metrics(scored(spark, [0, 0], [0.1, 0.2])).first()
    assert none.auc is None and none.average_precision == 0.0


def test_ranking_in_buckets_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 50)
    draw = random.Random(3)
    labels = [draw.randint(0, 1) for _ in range(600)]
    scores = [0.5 if draw.random() < 0.34 else round(draw.random(), 3) for _ in range(600)]
    row = mt.ranking_metrics(scored(spark, labels, scores)).first()
    assert row.auc == pytest.approx(brute_auc(labels, scores), abs=1e-12)
    seen = tp = total = 0
    for s in sorted(set(scores), reverse=True):
        here = [t for t, v in zip(labels, scores) if v == s]
        seen, tp = seen + len(here), tp + sum(here)
        total += sum(here) * tp / seen
    assert row.average_precision == pytest.approx(total / sum(labels), abs=1e-12)


def test_no_predicted_positives(spark):
    row = mt.binary_metrics(judged(spark, [(1, 0), (0, 0)])).first()
    assert (row.precision, row.recall, row.f1, row.mcc) == (0, 0, 0, 0)


def test_hard_auc(spark):
    pairs = [(1, 1)] * 2 + [(1, 0)] * 2 + [(0, 0)] * 3 + [(0, 1)]
    assert mt.hard_auc(judged(spark, pairs)).first().hard_auc == 0.625


def test_mcc(spark):
    assert mt.mcc(judged(spark, [(1, 1), (0, 1)])).first().mcc == 0
    assert mt.mcc(judged(spark, [(1, 1), (0, 0)])).first().mcc == pytest.approx(1)


def test_labels_from_scores(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(0.5,)], "s double").select(
        mt.to_label(F.col("s")).alias("a"), mt.to_label(F.col("s"), "half_even").alias("b"),
        mt.to_label(F.lit(1.0), "one").alias("c"), mt.argmax_label(F.col("s"), F.col("s")).alias("d"),
    ).first()
    assert tuple(row) == (1, 0, 1, 0)


def test_known_values(spark, small):
    from defectlab import fixtures as fx

    table = fx.predictions(spark, "/root/testdata/sf0.01")
    rank = mt.ranking_metrics(table).first()
    assert rank.auc == pytest.approx(0.503160077, abs=1e-8)
    assert rank.average_precision == pytest.approx(0.859679869, abs=1e-8)
    assert mt.mcc(table).first().mcc == pytest.approx(0.015254959, abs=1e-8)
    cells = mt.cells(table).first()
    assert (cells.tp, cells.tn, cells.fp, cells.fn) == (172, 30, 28, 169)


@pytest.mark.parametrize("per_bucket", [1_000_000, 7])
def test_summary(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", per_bucket)
    rows = [("m", i, v, v, v, v) for i, v in enumerate([0.1, 0.2, 0.4, 0.5])]
    rows += [("n", i, v, v, v, v) for i, v in enumerate([1.0, 3.0, 3.0, 2.0, 9.0])]
    runs = spark.createDataFrame(rows, "model string, run int, auc double, precision double, recall double, f1 double")
    found = {(r.model, r.metric): (r["mean"], r["median"], r["max"], r["min"]) for r in rn.summarize_runs(runs).collect()}
    assert found["m", "f1"] == pytest.approx((0.3, 0.3, 0.5, 0.1))
    assert found["n", "auc"] == pytest.approx((3.6, 3.0, 9.0, 1.0))


@pytest.mark.parametrize("per_bucket", [1_000_000, 2])
def test_best_epoch(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", per_bucket)
    accs = [0.5, 0.6, 0.6, 0.5, 0.4, 0.3, 0.9]
    rows = [(0, i + 1, a) for i, a in enumerate(accs)] + [(1, i + 1, a) for i, a in enumerate([0.1, 0.2, 0.3])]
    log = spark.createDataFrame(rows, "fold int, epoch int, acc double")
    found = {r.fold: (r.best_epoch, r.best_value, r.stop_epoch) for r in rn.best_epoch(log).collect()}
    assert found == {0: (2, 0.6, 6), 1: (3, 0.3, 3)}
