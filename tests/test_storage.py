import pytest
from pyspark.sql import functions as F

from defectlab import session
from defectlab.operators import changes as ch
from defectlab.sources import (
    read_commits,
    read_diffs,
    read_examples,
    read_matrix,
    read_project_commits,
    read_projects,
    read_scripts,
    write_changes,
    write_examples,
    write_runs,
)
from defectlab.sources.readers import read_csv_text
from defectlab.streaming import stream_changes
from defectlab.streaming.ingest import read_changes


def test_latin1_scripts_with_line_breaks(spark, tmp_path):
    body = 'id,Script.Content,Defect.Label\n1,"caf\xe9 ""x""\n# y",1\n2,,0\n'
    (tmp_path / "s.csv").write_bytes(body.encode("latin-1"))
    rows = read_scripts(spark, str(tmp_path / "s.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", 'caf\xe9 "x"\n# y', 1), ("2", None, 0)]


def test_changes_truncate_then_append(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(
        [("1", "a/b", "f", ' x "q"\ny', "")],
        "commit_id string, repo_name string, file_path string, deleted_lines string, added_lines string",
    )
    for mode, rows in (("overwrite", 1), ("append", 2), ("overwrite", 1)):
        write_changes(df, path, mode)
        back = read_csv_text(spark, path)
        assert back.count() == rows
    assert back.columns == ["Commit ID", "Repo Name", "File Path", "Deleted Lines", "Added Lines"]
    assert back.first()["Deleted Lines"] == ' x "q"\ny'


def test_project_changes_have_their_own_heads(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", "c", "b", "a")], "project_id long, title string, commit_id string, before string, after string")
    write_changes(df, str(tmp_path / "o"))
    assert read_csv_text(spark, str(tmp_path / "o")).columns == ["ProjectID", "TitleCommit", "CommitID", "Before", "After"]


def test_examples_by_split(spark, tmp_path):
    path = str(tmp_path / "ex")
    df = spark.createDataFrame([("a\né", 1, "train"), ("b", 0, "test")], "code string, label int, split string")
    write_examples(df, path)
    assert sorted(tuple(r) for r in read_examples(spark, path).collect()) == [("a\né", 1, "train"), ("b", 0, "test")]
    assert [tuple(r) for r in read_examples(spark, path + "/split=test").collect()] == [("b", 0)]


def test_runs_in_order(spark, tmp_path):
    rows = [(i, i / 10, 0.2, 0.3, 0.4) for i in (2, 0, 1)]
    write_runs(spark.createDataFrame(rows, "run int, auc double, precision double, recall double, f1 double"), str(tmp_path / "r"))
    lines = [line for f in sorted((tmp_path / "r").glob("part-*")) for line in f.read_text().split()]
    assert [x for x in lines if not x.startswith("AUC")] == ["0.0,0.2,0.3,0.4", "0.1,0.2,0.3,0.4", "0.2,0.2,0.3,0.4"]
    assert "AUC,PRECISION,RECALL,F1" in lines


def test_matrix_by_position(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name,y,skip,w one,w.two\n1,0,zz,1,2.5\n2,1,zz,0,3\n")
    rows = {r.doc_id: (r.label, list(r.features)) for r in read_matrix(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {"1": (0, [1.0, 2.5]), "2": (1, [0.0, 3.0])}


def test_landed_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"page":1,"total_pages":2,"projects":[{"id":5,"x":1}]}\n')
    (tmp_path / "c.json").write_text('{"project_id":5,"commits":[{"id":"a","title":"t"},{"id":"b","title":"u"}]}\n')
    (tmp_path / "d.json").write_text('{"project_id":5,"commit_id":"a","diffs":[{"diff":"@@","new_path":"x.yml"}]}\n')
    assert read_projects(spark, str(tmp_path / "p.json")).first().projects[0].id == 5
    assert [tuple(r) for r in read_project_commits(spark, str(tmp_path / "c.json")).collect()] == [(5, "a", "t"), (5, "b", "u")]
    assert tuple(read_diffs(spark, str(tmp_path / "d.json")).first()) == (5, "a", "x.yml", "@@")


def land(folder, name, sha, patch):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(
        '{"repository":"a/b","sha":"%s","files":[{"filename":"f","patch":"@@ -1 +1 @@\\n-%s"}]}\n' % (sha, patch)
    )


def test_stream_equals_batch_and_ignores_replays(spark, tmp_path):
    landing, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    go = lambda: stream_changes(spark, str(landing), out, progress, files_per_batch=1).awaitTermination()
    land(landing, "1.json", "s1", "x")
    land(landing, "2.json", "s2", "y")
    go()
    land(landing, "3.json", "s1", "x")
    land(landing, "4.json", "s3", "z")
    go()
    go()
    streamed = sorted(tuple(r)[:5] for r in read_changes(spark, out).collect())
    batch = ch.change_pairs(ch.first_files(read_commits(spark, str(landing))))
    assert streamed == sorted(tuple(r) for r in batch.collect())
    assert len(streamed) == 3


def test_a_repeated_batch_leaves_the_same_rows(spark, tmp_path):
    """A batch whose commit is lost is done again from the state before it."""
    landing, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"
    for n, shas in enumerate((("s1", "s2"), ("s2", "s3"), ("s3", "s1", "s4"))):
        for sha in shas:
            land(landing, f"{n}-{sha}.json", sha, sha)
        stream_changes(spark, str(landing), out, str(checkpoint)).awaitTermination()
    rows = sorted(map(tuple, read_changes(spark, out).select("commit_id", "batch").collect()))
    assert sorted(r[0] for r in rows) == ["s1", "s2", "s3", "s4"]
    last = max(int(f.name) for f in (checkpoint / "commits").iterdir() if f.name.isdigit())
    for f in (checkpoint / "commits").glob(f"*{last}*"):
        f.unlink()
    stream_changes(spark, str(landing), out, str(checkpoint)).awaitTermination()
    assert sorted(map(tuple, read_changes(spark, out).select("commit_id", "batch").collect())) == rows


def test_batches_read_nothing_that_was_written(spark, tmp_path, monkeypatch):
    """Earlier output may be gone: the keys are in the state."""
    import shutil

    landing, out = tmp_path / "in", tmp_path / "out"
    land(landing, "1.json", "s1", "x")
    stream_changes(spark, str(landing), str(out), str(tmp_path / "cp")).awaitTermination()
    shutil.move(out, tmp_path / "elsewhere")
    land(landing, "2.json", "s1", "x")
    land(landing, "3.json", "s2", "y")
    stream_changes(spark, str(landing), str(out), str(tmp_path / "cp")).awaitTermination()
    assert [r.commit_id for r in read_changes(spark, str(out)).collect()] == ["s2"]


def test_keys_are_forgotten_after_a_while(spark, tmp_path):
    landing, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for n, sha in enumerate(("s1", "s2", "s3", "s1")):
        land(landing, f"{n}.json", sha, "x")
        stream_changes(spark, str(landing), out, checkpoint, keep="0 seconds").awaitTermination()
    assert sorted(r.commit_id for r in read_changes(spark, out).collect()) == ["s1", "s1", "s2", "s3"]
    land(landing, "9.json", "s2", "x")
    everything = str(tmp_path / "all")
    for _ in range(2):
        stream_changes(spark, str(landing), everything, str(tmp_path / "cp2"), keep=None).awaitTermination()
    assert sorted(r.commit_id for r in read_changes(spark, everything).collect()) == ["s1", "s2", "s3"]


def test_first_file_of_a_name_in_a_payload(spark):
    rows = [("r", "c", [("b", "1"), ("a", None), ("b", None), ("a", "2"), (None, "3"), (None, "4")]), ("r", "d", []), ("r", "e", None)]
    df = spark.createDataFrame(rows, "repository string, sha string, files array<struct<filename:string,patch:string>>")
    assert {tuple(r)[2:] for r in ch.first_in_payload(df).collect()} == {("b", "1"), ("a", None), (None, "3")}


def test_stream_keeps_to_the_worklist(spark, tmp_path):
    land(tmp_path / "in", "1.json", "s1", "x")
    land(tmp_path / "in", "2.json", "s2", "y")
    work = spark.createDataFrame([(1, "a/b", "s2", "f")], "wl_id long, repository string, commit_id string, filepath string")
    out = str(tmp_path / "out")
    stream_changes(spark, str(tmp_path / "in"), out, str(tmp_path / "cp"), work).awaitTermination()
    assert [r.commit_id for r in read_changes(spark, out).collect()] == ["s2"]


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    assert session.shared_dir(spark) == session.shared_dir(spark)

    class Cluster:
        conf = {}

        class sparkContext:
            master, applicationId = "yarn", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)
    Cluster.conf = {"spark.checkpoint.dir": "hdfs:/shared"}
    assert session.scratch_path(Cluster, "x").startswith("hdfs:/shared/x-")


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).withColumn("v", F.array(F.lit(1.0)))
    assert sorted(session.cut_lineage(df).collect()) == sorted(df.collect())
