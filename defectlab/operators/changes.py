"""Commits to before/after change pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.functions.diff import joined_lines, line_kind, line_text, parse_patch, patch_body
from defectlab.plans.skew import skew_join

YAML_ENDINGS = ["yml", "yaml"]
FILE_KEY = ["repository", "commit_id", "filepath"]


def reject_reason(repository: Column, commit_id: Column, filepath: Column) -> Column:
    """Why a work-list row cannot be used; NULL for a good row."""
    parts = F.split(repository, "/")
    empty = [F.coalesce(c, F.lit("")) == "" for c in (F.get(parts, 0), F.get(parts, 1), commit_id, filepath)]
    return (
        F.when(repository.isNull() | ~F.contains(repository, F.lit("/")), "no owner")
        .when(F.size(parts) != 2, "not owner/name")
        .when(empty[0] | empty[1] | empty[2] | empty[3], "missing field")
    )


def mark_worklist(worklist: DataFrame) -> DataFrame:
    """The work list with its ``reason`` column."""
    return worklist.withColumn("reason", reject_reason(*[F.col(c) for c in FILE_KEY]))


def validate_worklist(worklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with ``reason``)."""
    marked = mark_worklist(worklist)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def is_yaml(path: Column) -> Column:
    """True where the text after the last dot is a YAML ending, in any case."""
    return F.coalesce(F.lower(F.substring_index(path, ".", -1)).isin(YAML_ENDINGS), F.lit(False))


def both_sides(df: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    return df.where((F.length(before) > 0) & (F.length(after) > 0))


def label_pairs(df: DataFrame) -> DataFrame:
    """Deleted text counts as defective, added text as clean."""
    return df.withColumns({"label_before": F.lit(1), "label_after": F.lit(0)})


def commit_files(commits: DataFrame) -> DataFrame:
    """One row per file of a commit, with its place in the payload."""
    return commits.select(
        "repository", F.col("sha").alias("commit_id"), F.posexplode("files").alias("pos", "file")
    ).select("repository", "commit_id", "pos", F.col("file.filename").alias("filepath"), F.col("file.patch").alias("patch"))


def first_files(commits: DataFrame) -> DataFrame:
    """Per commit and path the first file of that name.

    Each task keeps one file per key before the shuffle, so payloads landed
    many times cost no more than one.
    """
    unique = commit_files(commits).groupBy(*FILE_KEY)
    first = F.min(F.struct("pos", "patch")).alias("first")
    return unique.agg(first).select(*FILE_KEY, F.col("first.patch").alias("patch"))


def first_in_payload(commits: DataFrame) -> DataFrame:
    """Of each payload's files the first of every name, found inside the row: no shuffle."""
    placed = F.transform("files", lambda f, i: F.struct(f["filename"].alias("filepath"), i.alias("pos"), f["patch"].alias("patch")))
    ordered = commits.select("repository", F.col("sha").alias("commit_id"), F.array_sort(placed).alias("_files"))
    first = F.filter("_files", lambda f, i: (i == 0) | ~f["filepath"].eqNullSafe(F.get(F.col("_files"), i - 1)["filepath"]))
    return ordered.select("repository", "commit_id", F.inline(first)).drop("pos")


def match_files(worklist: DataFrame, commits: DataFrame) -> DataFrame:
    """Each usable work-list row with the patch of its file."""
    return skew_join(worklist, first_files(commits), FILE_KEY, "inner", ["wl_id"])


def unmatched(worklist: DataFrame, commits: DataFrame) -> DataFrame:
    """Usable work-list rows without a patch, and why."""
    commit_key = FILE_KEY[:2]
    known = commits.select("repository", F.col("sha").alias("commit_id")).distinct()
    paths = commit_files(commits).select(*FILE_KEY).distinct()
    lost = skew_join(worklist, paths, FILE_KEY, "left_anti", ["wl_id"])
    found = known.withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known"), "file missing").otherwise("commit missing")
    return skew_join(lost, found, commit_key, "left", ["wl_id"]).withColumn("reason", reason).drop("_known")


def change_pairs(files: DataFrame, mode: str = "strict") -> DataFrame:
    """Add ``deleted_lines`` and ``added_lines``; rows without a patch stay, blank.

    The sides are unfolded from a one-element array, so later filters on them
    use the parsed texts instead of parsing a second time.
    """
    kept = [c for c in files.columns if c != "patch"]
    sides = parse_patch(F.col("patch"), mode)
    texts = F.struct(
        joined_lines(sides["deleted"]).alias("deleted_lines"), joined_lines(sides["added"]).alias("added_lines")
    )
    return files.select(*kept, F.inline(F.array(texts)))


def patch_lines(df: DataFrame, keys: list[str], mode: str = "strict") -> DataFrame:
    """(keys, hunk, pos, kind, line) for the lines below every hunk header.

    ``hunk`` counts from 1 in the patch, ``pos`` from 1 in the hunk. Hunks and
    lines are both unfolded from the row itself, so nothing is shuffled.
    """
    hunks = F.split(patch_body(F.col("patch"), mode), r"\n(?=@@)")
    by_hunk = df.select(*keys, F.posexplode(hunks).alias("h", "text"))
    headed = F.startswith("text", F.lit("@@")).cast("int")  # a header takes place 0
    by_line = by_hunk.select(
        *keys, (F.col("h") + 1).alias("hunk"), headed.alias("_headed"), F.posexplode(F.split("text", "\n")).alias("pos", "raw")
    )
    kind = line_kind(F.col("raw"), mode)
    place = F.col("pos") + 1 - F.col("_headed")
    body = by_line.select(*keys, "hunk", place.alias("pos"), kind.alias("kind"), "raw").where("kind <> 'header'")
    signed = F.col("kind").isin("deleted", "added")
    text = F.when(signed, line_text(F.col("raw"), mode)).otherwise(F.col("raw"))
    return body.withColumn("line", text).drop("raw")


def change_totals(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Added and deleted line totals over all patches."""
    sides = df.select(parse_patch(F.col("patch"), mode).alias("s"))
    return sides.agg(
        F.coalesce(F.sum(F.size("s.added")), F.lit(0)).alias("added_lines"),
        F.coalesce(F.sum(F.size("s.deleted")), F.lit(0)).alias("deleted_lines"),
        F.count_if(F.col("s.added").isNull()).alias("without_patch"),
    )


def project_changes(commits: DataFrame, diffs: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """YAML diffs of the given (already selected) commits as before/after pairs.

    ``commits`` should come from ``relevance.semantic_matches`` or
    ``title_matches``, so that titles are judged before any diff is joined;
    the path test runs below the join.
    """
    if projects is not None:
        wanted = projects.select(F.explode("projects.id").alias("project_id")).distinct()
        commits = skew_join(commits, wanted, ["project_id"], "left_semi", ["commit_id"])
    key = ["project_id", "commit_id"]
    chosen = commits.groupBy(*key).agg(F.min("title").alias("title"))
    files = diffs.where(is_yaml(F.col("new_path")))
    joined = skew_join(files, chosen, key, "inner", ["new_path"])
    pairs = change_pairs(joined.withColumnRenamed("diff", "patch"))
    named = pairs.withColumnsRenamed({"deleted_lines": "before", "added_lines": "after"})
    return both_sides(named).select("project_id", "title", "commit_id", "new_path", "before", "after")


def commits_per_project(commits: DataFrame) -> DataFrame:
    return commits.groupBy("project_id").agg(F.count(F.lit(1)).alias("commits"))
