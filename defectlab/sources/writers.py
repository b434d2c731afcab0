"""DataFrames out to files, written by all tasks in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["METRICS", "runs_long", "write_changes", "write_examples", "write_runs", "write_scripts"]

# Column heads of the change and metric files.
CHANGE_HEADS = {
    "commit_id": "Commit ID",
    "repo_name": "Repo Name",
    "file_path": "File Path",
    "deleted_lines": "Deleted Lines",
    "added_lines": "Added Lines",
}
PROJECT_CHANGE_HEADS = {
    "project_id": "ProjectID",
    "title": "TitleCommit",
    "commit_id": "CommitID",
    "before": "Before",
    "after": "After",
}
METRICS = ["auc", "precision", "recall", "f1"]


def write_csv_text(df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8") -> None:
    """Header CSV that keeps blanks and line breaks inside quoted fields."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("encoding", encoding)
        .csv(path)
    )


def write_changes(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Change pairs as CSV with a header; ``overwrite`` truncates, ``append`` adds."""
    heads = CHANGE_HEADS if "deleted_lines" in df.columns else PROJECT_CHANGE_HEADS
    named = df.select(*[F.col(c).alias(h) for c, h in heads.items()])
    write_csv_text(named, path, mode)


def write_scripts(df: DataFrame, path: str) -> None:
    """Labelled scripts under the column heads they are read by; other columns stay."""
    heads = {"content": "Script.Content", "label": "Defect.Label"}
    write_csv_text(df.withColumnsRenamed(heads), path)


def write_examples(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per split."""
    df.select("code", "label", "split").write.mode("overwrite").partitionBy("split").json(path)


def write_runs(df: DataFrame, path: str) -> None:
    """Metric rows in run order under ``AUC,PRECISION,RECALL,F1``.

    Runs with a ``phase`` give one row per phase under
    ``Metric,AUC,Precision,Recall,F1``, Cross-Validation before Testing.
    """
    if "phase" in df.columns:
        heads = dict(zip(METRICS, ("AUC", "Precision", "Recall", "F1")))
        named = [F.col("phase").alias("Metric"), *[F.col(m).alias(h) for m, h in heads.items()]]
        ordered = df.orderBy("run", "phase").select(*named)
    else:
        ordered = df.orderBy("run").select(*[F.col(m).alias(m.upper()) for m in METRICS])
    ordered.write.mode("overwrite").option("header", True).csv(path)


def runs_long(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per run and metric."""
    return df.unpivot(keys or ["model", "run"], METRICS, "metric", "value")
