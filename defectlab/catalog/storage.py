"""Files written and read back, and the streaming job."""

import contextlib

from pyspark.sql import functions as F

from defectlab import fixtures as fx
from defectlab.catalog.changes import FIRST, VECTORS
from defectlab.catalog.changes import _relevant as relevant
from defectlab.catalog.registry import (
    FILES,
    PREDICTIONS,
    RUNS,
    SCRIPTS,
    WORKLIST,
    clean_sql,
    holdout_sql,
    query,
    side_sql,
)
from defectlab.functions.text import clean_text, drop_beyond_latin1
from defectlab.operators import changes as ch
from defectlab.operators import examples as ex
from defectlab.operators.metrics import align
from defectlab.session import cut_lineage, scratch_path
from defectlab.sources import (
    read_examples,
    read_predictions,
    read_scripts,
    read_worklist,
    write_changes,
    write_examples,
    write_runs,
)
from defectlab.sources.appends import append_batch, read_batches, start_over
from defectlab.sources.readers import read_csv_text, read_keyed
from defectlab.sources.writers import write_csv_text
from defectlab.streaming.ingest import read_changes, stream_changes


@query("s1_scripts", f"WITH {SCRIPTS} SELECT script_id, label, md5({clean_sql('content')}) AS content FROM scripts")
def s1_scripts(spark, sf):
    path = scratch_path(spark, "scripts")
    source = fx.scripts(spark, sf)
    named = source.select("script_id", F.col("content").alias("Script.Content"), F.col("label").alias("Defect.Label"))
    write_csv_text(named, path)
    back = read_scripts(spark, path, "UTF-8")
    return back.select(F.col("script_id").cast("long").alias("script_id"), "label", F.md5(clean_text(F.col("content"))).alias("content"))


@query("s1_latin1", rf"""WITH {SCRIPTS} SELECT script_id, label, md5(regexp_replace(content, '[^\x00-\x{{ff}}]', '', 'g')) AS content FROM scripts""")
def s1_latin1(spark, sf):
    """Scripts in a Latin-1 file, read as the original encoding."""
    path = scratch_path(spark, "latin1")
    source = fx.scripts(spark, sf).select("script_id", drop_beyond_latin1(F.col("content")).alias("Script.Content"), F.col("label").alias("Defect.Label"))
    write_csv_text(source, path, encoding="ISO-8859-1")
    back = read_scripts(spark, path, "ISO-8859-1")
    return back.select(F.col("script_id").cast("long").alias("script_id"), "label", F.md5(F.coalesce("content", F.lit(""))).alias("content"))


@query("s2_worklist", f"WITH {WORKLIST} SELECT wl_id, repository, coalesce(commit_id, '') AS commit_id, filepath FROM worklist")
def s2_worklist(spark, sf):
    path = scratch_path(spark, "worklist")
    write_csv_text(fx.worklist(spark, sf).withColumnRenamed("commit_id", "commit"), path)
    back = read_worklist(spark, path)
    return back.select(
        F.col("wl_id").cast("long").alias("wl_id"), "repository", F.coalesce("commit_id", F.lit("")).alias("commit_id"), "filepath"
    )


@query("s8_predictions", f"WITH {PREDICTIONS} SELECT example_id, label, score FROM predictions")
def s8_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    fx.predictions(spark, sf).select("example_id", "label", "score").write.option("header", True).csv(path)
    return read_predictions(spark, path)


@query("s8_two_files", f"WITH {PREDICTIONS} SELECT example_id, label, score FROM predictions WHERE phase = 'test'")
def s8_two_files(spark, sf):
    """Scores and labels in files of their own, each keyed; labels of other phases have no score."""
    scores, labels = scratch_path(spark, "scores"), scratch_path(spark, "labels")
    made = fx.predictions(spark, sf)
    made.where("phase = 'test'").select("example_id", "score").write.option("header", True).csv(scores)
    made.select("example_id", "label").write.option("header", True).csv(labels)
    both = align(read_keyed(spark, scores, "score double"), read_keyed(spark, labels, "label int"))
    return both.select("example_id", "label", "score")


def _matched(spark, sf):
    usable, _ = ch.validate_worklist(fx.worklist(spark, sf))
    return ch.change_pairs(ch.match_files(usable, fx.commits(spark, sf)))


@query(
    "k1_changes",
    f"""WITH {FILES}, {WORKLIST}, {FIRST},
    matched AS (SELECT u.*, patch FROM usable u JOIN first f ON u.repository = f.repository AND u.commit_id = f.commit_id
      AND u.filepath = f.filepath)
    SELECT commit_id, repository AS repo_name, filepath AS file_path, md5({side_sql('patch', '-')}) AS deleted_lines,
      md5({side_sql('patch', '+')}) AS added_lines FROM matched""",
)
def k1_changes(spark, sf):
    path = scratch_path(spark, "changes")
    renamed = _matched(spark, sf).withColumnsRenamed({"repository": "repo_name", "filepath": "file_path"})
    write_changes(renamed, path)
    back = read_csv_text(spark, path).toDF("commit_id", "repo_name", "file_path", "deleted_lines", "added_lines")
    sides = [F.md5(F.coalesce(c, F.lit(""))).alias(c) for c in ("deleted_lines", "added_lines")]
    return back.select("commit_id", "repo_name", "file_path", *sides)


CHANGED = f"""{FILES}, {WORKLIST}, {FIRST},
    matched AS (SELECT u.*, patch FROM usable u JOIN first f ON u.repository = f.repository AND u.commit_id = f.commit_id
      AND u.filepath = f.filepath)"""


@query("k1_appended", f"WITH {CHANGED} SELECT wl_id % 3 AS part, commit_id, filepath AS file_path FROM matched")
def k1_appended(spark, sf):
    """Changes appended in three batches after a truncation; one job dies before its batch is listed, all are repeated."""
    path = scratch_path(spark, "appends")
    whole = cut_lineage(_matched(spark, sf).withColumnsRenamed({"repository": "repo_name", "filepath": "file_path"}))

    def dies(df, folder):
        write_changes(df.limit(1), folder)
        raise InterruptedError

    append_batch(whole, path, "old", write_changes)
    start_over(spark, path)
    with contextlib.suppress(InterruptedError):
        append_batch(whole, path, "part-1", dies)
    for _ in range(2):
        for part in range(3):
            append_batch(whole.where(F.col("wl_id") % 3 == part), path, f"part-{part}", write_changes)

    def read(spark, folder):
        part = F.lit(int(folder[-1])).cast("long").alias("part")
        return read_csv_text(spark, folder).select(part, F.col("Commit ID").alias("commit_id"), F.col("File Path").alias("file_path"))

    return read_batches(spark, path, read)


@query(
    "k1_project_changes",
    f"""WITH {VECTORS}, pairs AS (SELECT project_id, commit_id, title, new_path, {side_sql('diff', '-')} AS before,
      {side_sql('diff', '+')} AS after FROM turns JOIN chosen USING (project_id, commit_id)
      WHERE lower(string_split(new_path, '.')[-1]) IN ('yml', 'yaml'))
    SELECT project_id::VARCHAR AS "ProjectID", commit_id AS "CommitID", md5(title) AS "TitleCommit", md5(before) AS "Before", md5(after) AS "After"
    FROM pairs WHERE before <> '' AND after <> ''""",
)
def k1_project_changes(spark, sf):
    """Project changes under their own heads, truncated once and read back by these."""
    path = scratch_path(spark, "project_changes")
    pairs = cut_lineage(ch.project_changes(relevant(spark, sf), fx.project_diffs(spark, sf), fx.project_pages(spark, sf)))
    for _ in range(2):
        write_changes(pairs, path)
    back = read_csv_text(spark, path)
    return back.select("ProjectID", "CommitID", *[F.md5(F.coalesce(c, F.lit(""))).alias(c) for c in ("TitleCommit", "Before", "After")])


SPLIT_EXAMPLES = f"""WITH {SCRIPTS} SELECT label, split, md5(content) AS code FROM
    ({holdout_sql('scripts', 'script_id', 0.2, '42')})"""


def _written_examples(spark, sf):
    path = scratch_path(spark, "examples")
    split = ex.holdout(fx.scripts(spark, sf), 0.2, 42, "script_id")
    write_examples(split.withColumnRenamed("content", "code"), path)
    return path


@query("k2_examples", SPLIT_EXAMPLES)
def k2_examples(spark, sf):
    back = read_examples(spark, _written_examples(spark, sf))
    return back.select("label", "split", F.md5("code").alias("code"))


@query("s6_examples", f"SELECT label, code FROM ({SPLIT_EXAMPLES})")
def s6_examples(spark, sf):
    back = read_examples(spark, _written_examples(spark, sf))
    return back.select("label", F.md5("code").alias("code"))


@query(
    "k3_runs_csv",
    f"""WITH {RUNS} SELECT round(auc, 6) AS "AUC", round(precision, 6) AS "PRECISION", round(recall, 6) AS "RECALL",
    round(f1, 6) AS "F1" FROM runs""",
)
def k3_runs_csv(spark, sf):
    path = scratch_path(spark, "runs")
    write_runs(fx.runs(spark, sf), path)
    back = spark.read.option("header", True).schema("AUC double, PRECISION double, RECALL double, F1 double").csv(path)
    return back.select(*[F.round(c, 6).alias(c) for c in back.columns])


@query(
    "k3_phase_runs_csv",
    f"""WITH {PREDICTIONS} SELECT CASE phase WHEN 'validation' THEN 'Cross-Validation' ELSE 'Testing' END AS "Metric",
      round(avg(score), 6) AS "AUC", round(avg(label), 6) AS "Precision", round(avg(prediction), 6) AS "Recall",
      round(max(score), 6) AS "F1" FROM predictions GROUP BY fold, phase""",
)
def k3_phase_runs_csv(spark, sf):
    """Per-fold means stand in for the four metrics."""
    path = scratch_path(spark, "phase_runs")
    phase = F.when(F.col("phase") == "validation", "Cross-Validation").otherwise("Testing")
    means = [F.avg("score").alias("auc"), F.avg("label").alias("precision"), F.avg("prediction").alias("recall"), F.max("score").alias("f1")]
    made = fx.predictions(spark, sf).groupBy(F.col("fold").alias("run"), phase.alias("phase")).agg(*means)
    write_runs(made, path)
    back = spark.read.option("header", True).schema("Metric string, AUC double, Precision double, Recall double, F1 double").csv(path)
    return back.select("Metric", *[F.round(c, 6).alias(c) for c in back.columns[1:]])


@query(
    "st1_stream_changes",
    f"""WITH {FILES}, {FIRST} SELECT repository, commit_id, filepath, md5({side_sql('patch', '-')}) AS deleted_lines,
    md5({side_sql('patch', '+')}) AS added_lines FROM first""",
)
def st1_stream_changes(spark, sf):
    """Payloads land, are taken up, land a second time; every file appears once."""
    landing, out, checkpoint = (scratch_path(spark, n) for n in ("landing", "stream", "progress"))
    payloads = fx.commits(spark, sf)
    for _ in range(2):
        payloads.write.mode("append").json(landing)
        stream_changes(spark, landing, out, checkpoint).awaitTermination()
    back = read_changes(spark, out)
    return back.select(*ch.FILE_KEY, *[F.md5(c).alias(c) for c in ("deleted_lines", "added_lines")])
