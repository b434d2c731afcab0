"""Values that went wrong once: large numbers, absent content, vectors of any length, ids that are paths."""

import pytest
from pyspark.sql import functions as F

from defectlab.operators import changes as ch
from defectlab.operators import examples as ex
from defectlab.operators import features as ft
from defectlab.operators import models as md
from defectlab.operators.relevance import similar_tokens
from defectlab.session import tune
from defectlab.sources import matrix_long, read_matrix, read_scripts
from defectlab.sources.writers import write_csv_text


def test_deviation_of_large_values(spark):
    cells = spark.createDataFrame([("t", 1e9 + i) for i in range(7)] + [("same", 5e-9)] * 7 + [("small", i * 1e-14) for i in range(7)], "term string, tf double")
    stats = {r["term"]: r for r in ft.scale_stats(cells, 7).collect()}
    assert stats["t"]["sd"] == pytest.approx(2.0, rel=1e-9)
    assert stats["t"]["z_of_zero"] == pytest.approx(-(1e9 + 3) / 2, rel=1e-9)
    assert stats["same"]["sd"] == 1.0
    assert stats["small"]["sd"] == pytest.approx(2e-14, rel=1e-9)
    half = {r["term"]: r for r in ft.scale_stats(cells.where("term = 't'"), 14).collect()}["t"]
    mean = (1e9 + 3) / 2
    assert half["sd"] == pytest.approx((sum((1e9 + i - mean) ** 2 for i in range(7)) / 14 + mean**2 / 2) ** 0.5, rel=1e-9)


def test_absent_content_is_dropped(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1), (2, "a\nb", 0), (3, "  ", 1)], "script_id long, content string, label int")
    write_csv_text(df.withColumnsRenamed({"content": "Script.Content", "label": "Defect.Label"}), str(tmp_path / "s"))
    back = read_scripts(spark, str(tmp_path / "s"), "UTF-8")
    assert [r["script_id"] for r in ex.preprocess_scripts(back, stem=False).orderBy("script_id").collect()] == ["2", "3"]


def test_closeness_is_a_cosine(spark):
    rows = [("same way", "NOUN", [3.0, 0.0]), ("long but off", "NOUN", [6.0, 8.0]), ("zero", "NOUN", [0.0, 0.0]), ("short", "VERB", [0.001, 0.0]), ("tag", "ADJ", [1.0, 0.0]), ("none", "NOUN", None)]
    df = spark.createDataFrame(rows, "token string, pos string, vector array<double>")
    assert {r["token"] for r in similar_tokens(df, [[0.5, 0.0], [0.0, 0.0]], 0.8).collect()} == {"same way", "short"}


def test_matrix_ids_may_be_paths(spark, tmp_path):
    spark.createDataFrame([("roles/a.yml", 1, "x", 2.0, 3.5)], "id string, label int, skipped string, a double, b double").write.option("header", True).csv(str(tmp_path / "m"))
    cells = matrix_long(read_matrix(spark, str(tmp_path / "m"))).collect()
    assert [tuple(r) for r in cells] == [("roles/a.yml", 1, 0, 2.0), ("roles/a.yml", 1, 1, 3.5)]


def test_first_of_equal_orders_is_settled(spark):
    rows = [(1, "a", "b", i) for i in range(20)]
    made = {ex.dedup_pairs(spark.createDataFrame(rows, "wl_id int, deleted_lines string, added_lines string, extra int").repartition(n), "wl_id").first()["extra"] for n in (1, 3, 7)}
    assert len(made) == 1


def test_places_in_a_patch_without_header(spark):
    df = spark.createDataFrame([(1, "-a\n+b"), (2, "@@ -1 +1 @@\n-a\n+b")], "id int, patch string")
    places = [(r["id"], r["pos"]) for r in ch.patch_lines(df, ["id"]).collect()]
    assert set(places) <= {(1, 1), (1, 2), (2, 1), (2, 2)} and {(2, 1), (2, 2)} <= set(places)


def test_runs_with_other_settings_are_refused(spark, tmp_path):
    out = str(tmp_path / "runs")
    one = lambda run: [("m", run, "Testing", 0.5, 0.5, 0.5, 0.5)]
    assert md._repeat(spark, one, 2, 1, out, "k=3").count() == 2
    assert md._repeat(spark, lambda run: 1 / 0, 2, 1, out, "k=3").count() == 2  # nothing is left to do
    with pytest.raises(ValueError, match="k=3"):
        md._repeat(spark, one, 2, 1, out, "k=4")


def test_pieces_grow_with_the_input(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        tune(spark, 100 << 40)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == (100 << 40) // (256 << 20)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert spark.range(1).select(F.lit(1)).count() == 1
