"""The three ways through the package, from files to results."""

from pyspark.sql import functions as F

from defectlab.operators import changes, examples, features, metrics, models, runs
from defectlab.sources import (
    missing_pages,
    read_commits,
    read_examples,
    read_predictions,
    read_scripts,
    read_worklist,
    write_changes,
    write_examples,
    write_runs,
    write_scripts,
)


def test_commits_to_examples(spark, tmp_path):
    (tmp_path / "work.csv").write_text(
        "wl_id,repository,commit,filepath\n" + "".join(f"{i},a/b,s{i},f.yml\n" for i in range(20)) + "98,ab,s1,f\n99,a/b,s77,f\n"
    )
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "1.json").write_text(
        "".join(
            '{"repository":"a/b","sha":"s%d","files":[{"filename":"f.yml","patch":"@@ -1 +1 @@\\n-old %d\\n+New  %d"}]}\n' % (i, i // 2, i // 2)
            for i in range(20)
        )
    )
    usable, rejected = changes.validate_worklist(read_worklist(spark, str(tmp_path / "work.csv")))
    commits = read_commits(spark, str(tmp_path / "landing"))
    assert rejected.count() == 1
    assert [r.reason for r in changes.unmatched(usable, commits).collect()] == ["commit missing"]
    pairs = changes.change_pairs(changes.match_files(usable, commits))
    write_changes(pairs.withColumnsRenamed({"repository": "repo_name", "filepath": "file_path"}), str(tmp_path / "changes"))
    unique = examples.dedup_pairs(examples.clean_pairs(pairs), order="wl_id")
    split = examples.carve_validation(examples.holdout(unique, 0.3, 42, "wl_id"), "wl_id")
    write_examples(examples.to_examples(split, ["split"]), str(tmp_path / "examples"))
    back = read_examples(spark, str(tmp_path / "examples"))
    assert {r.split: r.n for r in back.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"test": 6, "valid": 4, "train": 10}
    assert back.where("code = 'new 3' AND label = 0").count() == 1
    assert examples.split_overlap(back, "code").count() == 0


def test_scripts_to_metrics(spark, tmp_path):
    raw = spark.createDataFrame([("It's running\nfor ages", 1), (None, 0), ("# only\nclasses", 0)], "content string, label int")
    done = examples.preprocess_scripts(raw, comments=False)
    assert sorted((r.content, r.label) for r in done.collect()) == [("class", 0), ("it run for ag", 1)]
    write_scripts(done, str(tmp_path / "s"))
    assert read_scripts(spark, str(tmp_path / "s"), "UTF-8").count() == 2
    (tmp_path / "p.csv").write_text("example_id,label,score\n1,0,0.1\n2,0,0.4\n3,1,0.35\n4,1,0.8\n")
    scored = read_predictions(spark, str(tmp_path / "p.csv")).withColumn("prediction", metrics.to_label(F.col("score")))
    assert metrics.roc_auc(scored).first().auc == 0.75
    assert metrics.binary_metrics(scored).first().recall == 0.5


def test_terms_to_forest_runs(spark, tmp_path):
    texts = [(i, "bad code here" if i % 3 == 0 else "good code there", int(i % 3 == 0)) for i in range(60)]
    table, _ = features.vectorize(spark.createDataFrame(texts, "id long, text string, label int"), "text", weighting="bow")
    chosen, _ = models.l1_select(table, c=10.0)
    slim = features.select_features(table, sorted(r.term_id for r in chosen.collect()))
    made = models.iterate(slim, "id", n=2, k=2, trees=3, max_depth=3)
    write_runs(made.drop("phase"), str(tmp_path / "runs"))
    summary = {r.metric: r for r in runs.summarize_runs(made).collect()}
    assert summary["auc"]["min"] <= summary["auc"]["median"] <= summary["auc"]["max"] == 1.0
    assert runs.compare(made).first().best_f1


def test_an_empty_page_ends_a_listing(spark):
    landed = spark.createDataFrame(
        [(1, 9, [(1,)]), (4, 9, [])], "page int, total_pages int, projects array<struct<id:long>>"
    )
    assert sorted(r.page for r in missing_pages(landed, items="projects").collect()) == [2, 3]
