"""Splits that keep equal contents together: sizes, unity, repeatability."""

import random

import pytest
from pyspark.sql import functions as F

from defectlab.operators import examples as ex
from defectlab.plans import skew


@pytest.mark.parametrize("seed", range(20))
def test_unit_counts_meet_the_target(seed):
    rng = random.Random(seed)
    sizes = {n: rng.randrange(1, 40) for n in rng.sample(range(2, 30), 5)}
    p, rows = rng.random(), None
    for singles in (200, 0):
        whole = sizes | ({1: singles} if singles else {})
        taken = ex.unit_counts(whole, p)
        rows = sum(n * k for n, k in whole.items())
        held, target = sum(n * k for n, k in taken.items()), -(-rows * p // 1)
        assert all(0 <= taken[n] <= whole[n] for n in whole)
        left = [n for n in whole if taken[n] < whole[n]]
        assert held == target if singles else 0 <= target - held < min(left, default=1 << 60)


def _rows(spark):
    texts = ["hot"] * 90 + [f"t{i % 60}" for i in range(100)] + [f"u{i}" for i in range(80)] + [None] * 3 + [""] * 2
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, split_by string").repartition(5)


@pytest.mark.parametrize("p", [0.0, 0.1, 0.3, 0.75, 1.0])
def test_groups_stay_whole_and_sizes_are_exact(spark, p):
    rows = ex.grouped_holdout(_rows(spark), p, 7, F.col("text")).collect()
    assert len(rows) == 275
    sides = {}
    for r in rows:
        sides.setdefault(r["text"], set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    assert sum(r["split"] == "test" for r in rows) == -(-275 * p // 1)


def test_hot_groups_are_split_up_for_the_join_only(spark, monkeypatch):
    whole = sorted(map(str, ex.grouped_holdout(_rows(spark), 0.6, 7, F.col("text")).collect()))
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    assert sorted(map(str, ex.grouped_holdout(_rows(spark).repartition(2), 0.6, 7, F.col("text")).collect())) == whole


def test_seeds_differ_and_empty_tables(spark):
    a, b = (ex.grouped_holdout(_rows(spark), 0.4, s, F.col("text")).where("split = 'test'").select("id").collect() for s in (1, 2))
    assert sorted(a) != sorted(b)
    assert ex.grouped_holdout(_rows(spark).limit(0), 0.4, 1, F.col("text")).collect() == []
    assert ex.split_overlap(ex.grouped_holdout(_rows(spark), 0.4, 1, F.col("text")), "text").count() == 0
