"""Files in, DataFrames out. Schemas are declared, never inferred from data."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = [
    "DATASETS",
    "flatten_dump",
    "matrix_long",
    "missing_pages",
    "read_commits",
    "read_diffs",
    "read_examples",
    "read_matrix",
    "read_predictions",
    "read_project_commits",
    "read_projects",
    "read_scripts",
    "read_texts",
    "read_worklist",
]

COMMIT_SCHEMA = "repository string, sha string, files array<struct<filename:string,patch:string>>"
PROJECT_SCHEMA = "page int, total_pages int, projects array<struct<id:long>>"
PROJECT_COMMIT_SCHEMA = "project_id long, commits array<struct<id:string,title:string>>"
DIFF_SCHEMA = "project_id long, commit_id string, diffs array<struct<diff:string,new_path:string>>"
EXAMPLE_SCHEMA = "code string, label int"

# Dataset codes of the script dump.
DATASETS = [(0, "Mozilla"), (1, "Openstack"), (2, "Wikimedia")]

PAGES_PER_BLOCK = 10_000


# Bytes of a table, for each core, that are cheap to deal out.
SPREAD_BYTES = 64 << 20


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table for work that is heavy per row.

    A file can be read by no more tasks than it has row groups. A table of fewer
    files than the session has cores, and of at most SPREAD_BYTES a core, is dealt
    out evenly; larger ones, or more files, keep the pieces of their scan.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if len(df.inputFiles()) < cores and size <= cores * SPREAD_BYTES else df


def read_csv_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with quoted multi-line fields, every column as text."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .csv(path)
    )


def read_scripts(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Labelled scripts from ``Script.Content`` and ``Defect.Label``; other columns stay, absent content stays NULL."""
    raw = read_csv_text(spark, path, encoding)
    kept = [F.col(f"`{c}`") for c in raw.columns if c not in ("Script.Content", "Defect.Label")]
    return raw.select(
        *kept,
        F.col("`Script.Content`").alias("content"),
        F.col("`Defect.Label`").cast("int").alias("label"),
    )


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    """Commit work list, columns found by name."""
    raw = read_csv_text(spark, path)
    return raw.select(
        *[c for c in raw.columns if c not in ("repository", "commit", "filepath")],
        "repository",
        F.col("commit").alias("commit_id"),
        "filepath",
    )


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Landed commit payloads, one JSON object per line."""
    return spark.read.schema(COMMIT_SCHEMA).json(path)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROJECT_SCHEMA).json(path)


def read_project_commits(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit of a project."""
    landed = spark.read.schema(PROJECT_COMMIT_SCHEMA).json(path)
    return landed.select("project_id", F.explode("commits").alias("c")).select(
        "project_id", F.col("c.id").alias("commit_id"), F.col("c.title").alias("title")
    )


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """One row per changed file of a commit."""
    landed = spark.read.schema(DIFF_SCHEMA).json(path)
    return landed.select("project_id", "commit_id", F.explode("diffs").alias("d")).select(
        "project_id", "commit_id", F.col("d.new_path").alias("new_path"), F.col("d.diff").alias("diff")
    )


def missing_pages(landed: DataFrame, listing: list[str] | None = None, items: str | None = None) -> DataFrame:
    """Pages 1..total_pages of each listing that have not landed.

    With ``items`` naming the array of a page's entries, a listing ends at its
    first empty page if that comes earlier. Expected pages are made in blocks, so a listing of any length never
    becomes one array.
    """
    listing = listing or []
    last_page = F.max("total_pages")
    if items:
        last_page = F.least(last_page, F.min(F.when(F.size(items) == 0, F.col("page"))))
    totals = landed.groupBy(*listing).agg(last_page.alias("_total"))
    blocks = totals.where("_total > 0").select(
        *listing, "_total", F.explode(F.expr(f"sequence(0, (_total - 1) div {PAGES_PER_BLOCK})")).alias("_block")
    )
    first = F.col("_block") * PAGES_PER_BLOCK + 1
    last = F.least(F.col("_total").cast("long"), first + (PAGES_PER_BLOCK - 1))
    wanted = blocks.select(*listing, F.explode(F.sequence(first, last)).alias("page"))
    have = landed.select(*listing, F.col("page").cast("long").alias("page")).distinct()
    return wanted.join(have, [*listing, "page"], "left_anti").withColumn("page", F.col("page").cast("int"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines examples; a ``split`` column appears for a partitioned folder."""
    return spark.read.schema(EXAMPLE_SCHEMA).json(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Dense matrix by position: id (as text, it may be a path), label, one skipped column, then features."""
    raw = spark.read.option("header", True).csv(path)
    row_id, label, _, *features = raw.columns
    typed = raw.select(
        F.col(f"`{row_id}`").alias("doc_id"),
        F.col(f"`{label}`").alias("label").cast("int"),
        *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)],
    )
    names = typed.columns[2:]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(typed)


def matrix_long(matrix: DataFrame) -> DataFrame:
    """The same matrix as (doc_id, label, feature index, value) rows."""
    return matrix.select("doc_id", "label", F.posexplode(vector_to_array("features")).alias("feature", "value"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Scores and labels keyed by example."""
    return spark.read.schema("example_id long, label int, score double").option("header", True).csv(path)


def read_keyed(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of values (its DDL) keyed by example, as scores and labels in files of their own are."""
    return spark.read.schema(f"example_id long, {column}").option("header", True).csv(path)


def flatten_dump(df: DataFrame) -> DataFrame:
    """Script-dump maps to one row per script with its dataset's name."""
    names = F.create_map(*[F.lit(v) for pair in DATASETS for v in pair])
    return df.select(F.explode("dump").alias("file_id", "s")).select(
        "file_id",
        F.col("s.content").alias("content"),
        F.col("s.label").alias("label"),
        F.col("s.dataset_id").alias("dataset_id"),
        F.element_at(names, F.col("s.dataset_id")).alias("dataset"),
    )
