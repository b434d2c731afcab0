import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from defectlab.operators import examples as ex
from defectlab.operators import features as ft
from defectlab.operators import models as md


@pytest.fixture(scope="module")
def table(spark):
    """Feature 0 decides the label, the others do not."""
    rows = []
    for i in range(90):
        label = i % 3 == 0
        rows.append((i, int(label), Vectors.sparse(4, {0: 4.0 if label else 1.0, 1: float(i % 5), 2: float(i % 7)})))
    return spark.createDataFrame(rows, ["id", "label", "features"])


def test_l1_keeps_the_telling_feature(table):
    chosen, accuracy = md.l1_select(table, c=1.0)
    assert 0 in {r.term_id for r in chosen.collect()}
    assert 3 not in {r.term_id for r in chosen.collect()}
    assert accuracy == 1.0


def test_scaling_uses_the_population_deviation(table):
    values = [r.features[0] for r in md.scaled_features(table).collect()]
    mean = sum(values) / len(values)
    assert sum((v - mean) ** 2 for v in values) / len(values) == pytest.approx(1.0)


def test_grid(table):
    rows = md.grid_search_l1(table, "id", scaled=True).collect()
    assert [r.c for r in rows] == pytest.approx([10 ** (-4 + 8 * i / 9) for i in range(10)])
    assert sum(r.best for r in rows) == 1
    assert next(r for r in rows if r.best).accuracy == max(r.accuracy for r in rows)


def test_every_row_is_predicted_once(table):
    placed = ex.assign_folds(table, 3, "id")
    rows = md.cross_val_predict(placed, md.forest(5, seed=1, max_depth=4), "id", 3).collect()
    assert sorted(r.id for r in rows) == list(range(90))
    assert sum(r.label == r.prediction for r in rows) > 80


def test_iterations_are_repeatable(table):
    runs = [sorted(map(tuple, md.iterate(table, "id", n=2, k=2, trees=3, max_depth=3, seed=5).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    assert [r[1] for r in runs[0]] == [0, 1]


def test_runs_are_resumed(table, tmp_path, monkeypatch):
    out = str(tmp_path / "runs")
    small = {"k": 2, "trees": 3, "max_depth": 3, "seed": 5}
    md.iterate(table, "id", n=1, out=out, **small)
    made, real = [], md.cross_val_predict

    def counted(*args):
        made.append(1)
        return real(*args)

    monkeypatch.setattr(md, "cross_val_predict", counted)
    rows = sorted(map(tuple, md.iterate(table, "id", n=3, out=out, **small).select("run", "phase", "auc", "f1").collect()))
    assert len(made) == 2
    assert rows == sorted(map(tuple, md.iterate(table, "id", n=3, **small).select("run", "phase", "auc", "f1").collect()))


def test_repeated_holdout(table):
    rows = md.iterate_holdout(table, "id", n=1, k=2, trees=3, max_depth=3).collect()
    assert sorted(r.phase for r in rows) == ["Cross-Validation", "Testing"]
    assert all(0 <= r.auc <= 1 for r in rows)


def test_small_forest(table):
    assert md.small_forest().getNumTrees() == 17
    assert md.small_forest().getMinInstancesPerNode() == 8


def test_vectors_and_slices(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "a"), (3, "c a b")], "id long, text string")
    made, model = ft.vectorize(df, "text", vocab_size=2, weighting="bow")
    assert model.stages[0].vocabulary == ["a", "b"]
    assert {r.id: list(r.features) for r in made.collect()} == {1: [2, 1], 2: [1, 0], 3: [1, 1]}
    assert {r.id: list(r.features) for r in ft.select_features(made, [1]).collect()} == {1: [1], 2: [0], 3: [1]}
    weighted, _ = ft.vectorize(df, "text")
    assert weighted.where("id = 2").first().features[0] == 0.0


def test_predictions_carry_a_score(table):
    model = md.forest(5, seed=1, max_depth=4).fit(table)
    assert md._scored(model, table, "id").where(~F.col("score").between(0, 1)).count() == 0


def test_the_forest_query_uses_all_terms(spark, small):
    from defectlab import fixtures as fx
    from defectlab.catalog import models as queries

    terms = ft.document_frequency(fx.scripts(spark, small), "content").count()
    assert queries._vectors(spark, small).first()["features"].size == terms > 500


def test_model_queries_return_fitted_results(spark, small):
    """Real fits over the whole small table: one row for each script or run, and scores that tell the classes apart."""
    from defectlab import fixtures as fx
    from defectlab.catalog import models as queries

    labels = {r["script_id"]: r["label"] for r in fx.scripts(spark, small).select("script_id", "label").collect()}
    rows = queries.m7_cross_val_predict(spark, small).collect()
    assert {r["script_id"]: r["label"] for r in rows} == labels and len(rows) == len(labels)
    good, bad = ([r["score"] for r in rows if r["label"] == side] for side in (1, 0))
    assert sum(good) / len(good) > sum(bad) / len(bad)
    tested = queries.m6_bounded_forest(spark, small).collect()
    assert len(tested) == -(-3 * len(labels) // 10)
    runs = queries.m9_holdout(spark, small).collect()
    assert sorted((r["run"], r["phase"]) for r in runs) == [(i, p) for i in range(2) for p in ("Cross-Validation", "Testing")]
    assert all(0 <= r[m] <= 1 for r in runs for m in ("precision", "recall", "f1"))
