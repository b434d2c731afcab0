import pytest
from pyspark.sql import functions as F

from defectlab.functions.diff import parse_patch
from defectlab.operators import changes as ch
from defectlab.operators.examples import dedup_pairs, label_pairs, to_examples
from defectlab.sources import flatten_dump, missing_pages

PATCH = "@@ -1,2 +1,2 @@\n - name: a\n-old\r\n+new\n!x\n ctx"


def parsed(spark, patch, mode="strict"):
    row = spark.createDataFrame([(patch,)], "patch string").select(parse_patch(F.col("patch"), mode).alias("s")).first()
    return row.s.deleted, row.s.added


@pytest.mark.parametrize(
    ("patch", "mode", "deleted", "added"),
    [
        (PATCH, "strict", ["old"], ["new"]),
        (PATCH, "lenient", [" name: a", "old"], ["new"]),
        ("@@ -1 +1 @@\n-a\n+b", "strict", ["a"], ["b"]),
        ("--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b", "strict", ["a"], ["b"]),
        ("@@ -1 +1 @@\n-\n+\r\r\n-a\r", "strict", ["", "a"], [""]),
        ("@@ -1 +1 @@\n\t +x\n ! -y\n! -z", "lenient", [], ["x"]),
        ("-a\n+b", "strict", ["a"], ["b"]),
        ("-a\n+b", "lenient", [], ["b"]),
        ("@@ -1 +1 @@\n-a b\u0085-c\n+d", "strict", ["a b\u0085-c"], ["d"]),
        ("", "strict", [], []),
        (None, "strict", None, None),
    ],
)
def test_parse_patch(spark, patch, mode, deleted, added):
    assert parsed(spark, patch, mode) == (deleted, added)


def test_null_patch_keeps_its_row(spark):
    files = spark.createDataFrame([(1, None), (2, "@@ -1 +1 @@\n-a")], "id int, patch string")
    rows = {r.id: (r.deleted_lines, r.added_lines) for r in ch.change_pairs(files).collect()}
    assert rows == {1: ("", ""), 2: ("a", "")}
    totals = ch.change_totals(files).first()
    assert (totals.added_lines, totals.deleted_lines, totals.without_patch) == (0, 1, 1)


def test_hunks_are_numbered_and_headers_left_out(spark):
    patch = "@@ -1 +1 @@ x\n-a\n+b\n@@ -9 +9 @@\n c\n-d"
    lines = ch.patch_lines(spark.createDataFrame([(1, patch)], "id int, patch string"), ["id"])
    rows = [(r.hunk, r.pos, r.kind, r.line) for r in lines.orderBy("hunk", "pos").collect()]
    assert rows == [(1, 1, "deleted", "a"), (1, 2, "added", "b"), (2, 1, "context", " c"), (2, 2, "deleted", "d")]


def test_worklist_reasons(spark):
    rows = [(1, "a/b/c", "s", "f"), (2, "ab", "s", "f"), (3, "/b", "s", "f"), (4, "a/b", "s", "f"), (5, "a/b", None, "f"), (6, None, "s", "f")]
    work = spark.createDataFrame(rows, "wl_id long, repository string, commit_id string, filepath string")
    good, bad = ch.validate_worklist(work)
    assert [r.wl_id for r in good.collect()] == [4]
    assert {r.wl_id: r.reason for r in bad.collect()} == {
        1: "not owner/name", 2: "no owner", 3: "missing field", 5: "missing field", 6: "no owner",
    }


def test_yaml_paths(spark):
    paths = ["x.YML", "a.yaml.bak", "yml", "dir.yml/x", None, "roles/a.yaml"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(ch.is_yaml(F.col("p")).alias("y"))
    assert [r.y for r in df.collect()] == [True, False, True, False, False, True]


def test_both_sides(spark):
    df = spark.createDataFrame([("", "x"), ("a", "b"), (None, "x")], "before string, after string")
    assert ch.both_sides(df).collect() == [("a", "b")]


COMMITS = "repository string, sha string, files array<struct<filename:string,patch:string>>"


def test_first_of_equal_names_wins_and_duplicates_stay(spark):
    commits = spark.createDataFrame(
        [("a/b", "1", [("f", "first"), ("f", "second"), ("g", None)]), ("a/b", "1", [("f", "first")])], COMMITS
    )
    work = spark.createDataFrame(
        [(1, "a/b", "1", "f"), (2, "a/b", "1", "f"), (3, "a/b", "1", "h"), (4, "a/b", "2", "f"), (5, "a/b", "1", "g")],
        "wl_id long, repository string, commit_id string, filepath string",
    )
    matched = {r.wl_id: r.patch for r in ch.match_files(work, commits).collect()}
    assert matched == {1: "first", 2: "first", 5: None}
    reasons = {r.wl_id: r.reason for r in ch.unmatched(work, commits).collect()}
    assert reasons == {3: "file missing", 4: "commit missing"}


def test_blank_sides_give_no_example(spark):
    pairs = spark.createDataFrame([(1, "x", " \t")], "id int, deleted_lines string, added_lines string")
    assert [(r.code, r.label) for r in to_examples(pairs).collect()] == [("x", 1)]
    assert label_pairs(pairs).first()[3:] == (1, 0)


def test_dedup_keeps_the_first(spark):
    rows = [(2, "a", "b"), (1, "a", "b"), (3, "ab", ""), (4, None, "b"), (5, None, "b")]
    df = spark.createDataFrame(rows, "id long, deleted_lines string, added_lines string")
    assert sorted(r.id for r in dedup_pairs(df, "id").collect()) == [1, 3, 4]


def test_missing_pages(spark, monkeypatch):
    monkeypatch.setattr("defectlab.sources.readers.PAGES_PER_BLOCK", 3)
    landed = spark.createDataFrame([("x", 1, 8), ("x", 2, 8), ("x", 8, 8), ("y", 1, 1)], "l string, page int, total_pages int")
    rows = sorted((r.l, r.page) for r in missing_pages(landed, ["l"]).collect())
    assert rows == [("x", p) for p in (3, 4, 5, 6, 7)]
    assert sorted(r.page for r in missing_pages(landed.where("l = 'x'").drop("l")).collect()) == [3, 4, 5, 6, 7]


def test_project_changes(spark):
    commits = spark.createDataFrame([(1, "a", "t"), (2, "b", "u")], "project_id long, commit_id string, title string")
    diffs = spark.createDataFrame(
        [(1, "a", "x.yml", "@@ -1 +1 @@\n-p\n+q"), (1, "a", "x.py", "@@ -1 +1 @@\n-p\n+q"), (2, "b", "y.yaml", "@@ -1 +1 @@\n-p\n+q"),
         (1, "a", "z.yml", "@@ -1 +1 @@\n-p")],
        "project_id long, commit_id string, new_path string, diff string",
    )
    projects = spark.createDataFrame([(1, 1, [(1,)])], "page int, total_pages int, projects array<struct<id:long>>")
    rows = ch.project_changes(commits, diffs, projects).collect()
    assert [(r.project_id, r.title, r.new_path, r.before, r.after) for r in rows] == [(1, "t", "x.yml", "p", "q")]


def test_flatten_dump(spark):
    df = spark.createDataFrame(
        [({"f": ("c", 1, 2), "g": ("d", 0, 9)},)],
        "dump map<string, struct<content:string,label:int,dataset_id:int>>",
    )
    rows = {r.file_id: (r.content, r.label, r.dataset) for r in flatten_dump(df).collect()}
    assert rows == {"f": ("c", 1, "Wikimedia"), "g": ("d", 0, None)}
