"""Appends that are killed and repeated leave the rows of appends that are not."""

import pytest
from pyspark.sql import functions as F

from defectlab.sources.appends import append_batch, read_batches, start_over
from defectlab.sources.writers import write_runs

READ = "AUC double, PRECISION double, RECALL double, F1 double"


def runs(spark, first):
    return spark.createDataFrame([(i, i / 10, 0.2, 0.3, 0.4) for i in range(first, first + 3)], "run int, auc double, precision double, recall double, f1 double")


def rows(spark, path):
    found = read_batches(spark, path, lambda s, folder: s.read.option("header", True).schema(READ).csv(folder))
    return sorted(r["AUC"] for r in found.collect()) if found is not None else None


def half(df, folder):
    write_runs(df.where(F.col("run") % 2 == 0), folder)
    raise InterruptedError


def test_killed_and_repeated_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert rows(spark, path) is None
    assert append_batch(runs(spark, 0), path, "a", write_runs)
    with pytest.raises(InterruptedError):
        append_batch(runs(spark, 3), path, "b", half)
    assert rows(spark, path) == [0.0, 0.1, 0.2]  # a batch that is not listed does not count
    assert append_batch(runs(spark, 3), path, "b", write_runs)
    whole = rows(spark, path)
    assert whole == [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]
    for batch, first in (("a", 0), ("b", 3)):
        assert not append_batch(runs(spark, first), path, batch, write_runs)
    assert rows(spark, path) == whole


def test_truncation_is_one_step(spark, tmp_path):
    path = str(tmp_path / "runs")
    append_batch(runs(spark, 0), path, "a", write_runs)
    start_over(spark, path)
    assert rows(spark, path) is None
    with pytest.raises(InterruptedError):
        append_batch(runs(spark, 6), path, "a", half)
    assert rows(spark, path) is None
    append_batch(runs(spark, 6), path, "a", write_runs)
    assert rows(spark, path) == [0.6, 0.7, 0.8]
