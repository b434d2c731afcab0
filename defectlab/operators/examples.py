"""Labelled examples: cleaning, duplicates, splits and folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.functions.stem import stem_text
from defectlab.functions.text import clean_text, non_blank, normalize_script, strip_comments
from defectlab.operators.changes import label_pairs
from defectlab.plans.ranks import hash_holdout, hash_rank, ordered_rank
from defectlab.plans.skew import group_join, skew_join
from defectlab.session import cut_lineage


def preprocess_scripts(df: DataFrame, stem: bool = True, strip_punct: bool = False, comments: bool = True) -> DataFrame:
    """Script contents normalised and stemmed; rows without content are dropped.

    ``comments=False`` removes comments first.
    """
    content = F.col("content") if comments else strip_comments(F.col("content"))
    cleaned = drop_null(df, ["content"]).withColumn("content", normalize_script(content, strip_punct))
    return cleaned.withColumn("content", stem_text("content")) if stem else cleaned


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Both sides of every pair cleaned."""
    sides = {c: clean_text(F.col(c)) for c in ("deleted_lines", "added_lines")}
    return pairs.withColumns(sides)


def dedup_pairs(df: DataFrame, order: str, key: tuple[str, ...] = ("deleted_lines", "added_lines")) -> DataFrame:
    """The first row by ``order`` for every distinct ``key``; where ``order`` repeats, by a hash of the row.

    Rows meet on a digest of the key, and each task keeps one row per key
    before anything is shuffled, so any number of copies is harmless.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in key]
    lengths = [F.length(p).cast("string") for p in parts]
    digest = F.sha2(F.concat_ws(":", *lengths, *parts), 256)
    first = F.min_by(F.struct(*df.columns), F.struct(F.col(order), F.xxhash64(*df.columns))).alias("row")
    return df.groupBy(digest.alias("_key")).agg(first).select("row.*")


def drop_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def keep_non_blank(df: DataFrame, col: str) -> DataFrame:
    return df.where(non_blank(F.col(col)))


def to_examples(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One (code, label) row per side that is not blank."""
    labelled = label_pairs(pairs)
    sides = F.array(
        F.struct(F.col("deleted_lines").alias("code"), F.col("label_before").alias("label")),
        F.struct(F.col("added_lines").alias("code"), F.col("label_after").alias("label")),
    )
    return keep_non_blank(labelled.select(*(keep or []), F.inline(sides)), "code")


def holdout(
    df: DataFrame, p: float, seed: int | Column, key: str, by: list[str] | None = None, name: str = "split"
) -> DataFrame:
    """Random split with exactly ceil(n * p) test rows, per ``by`` if given."""
    return hash_holdout(df, key, p, seed, by, name)


def unit_counts(sizes: dict[int, int], p: float) -> dict[int, int]:
    """How many groups of each size to hold out so that their rows are ceil(rows * p).

    Each size gives its share, and what is missing is filled from the largest size
    that fits. If something is missing still, one more group comes in and smaller
    ones go for it. It is met exactly where single rows are there to fill with, and
    otherwise missed by less than the smallest group that is left.
    """
    target = math.ceil(sum(n * units for n, units in sizes.items()) * p)
    taken = {n: math.floor(units * p) for n, units in sizes.items()}
    gap = target - sum(n * k for n, k in taken.items())
    for n in sorted(sizes, reverse=True):
        more = min(sizes[n] - taken[n], gap // n)
        taken[n] += more
        gap -= more * n
    for n in sorted(n for n in sizes if gap and taken[n] < sizes[n]):
        swapped, over = taken | {n: taken[n] + 1}, n - gap
        for smaller in sorted((m for m in sizes if m < n), reverse=True):
            fewer = min(swapped[smaller], over // smaller)
            swapped[smaller] -= fewer
            over -= fewer * smaller
        if over == 0:
            return swapped
    return taken


def grouped_holdout(
    df: DataFrame, p: float, seed: int, group: Column, name: str = "split", labels: tuple[str, str] = ("test", "train")
) -> DataFrame:
    """Random split in which rows of one ``group`` (equal contents, linked rows) stay together; NULL is a group.

    Groups meet on a digest. Of the groups of each size the first by seeded hash are
    held out, as many as ``unit_counts`` says; only these numbers reach the driver,
    one for each distinct size.
    """
    digest = F.coalesce(F.md5(group.cast("string")), F.lit("none"))
    units = cut_lineage(df.groupBy(digest.alias("_unit")).agg(F.count(F.lit(1)).alias("_n")))
    sizes = units.groupBy("_n").agg(F.count(F.lit(1)).alias("units"))
    taken = unit_counts({r["_n"]: r["units"] for r in sizes.collect()}, p)  # sizes differ, so they are at most sqrt(2 * rows)
    wanted = df.sparkSession.createDataFrame(list(taken.items()), "_n long, _take long")
    ranked = hash_rank(units, "_unit", seed, ["_n"], "_rank").join(F.broadcast(wanted), "_n")
    held = cut_lineage(ranked.where(F.col("_rank") <= F.col("_take")).select("_unit", F.lit(True).alias("_held")))
    keyed = df.withColumn("_unit", digest)
    marked = skew_join(keyed, held, ["_unit"], "left", df.columns, units.select("_unit", F.col("_n").alias("n")))
    return marked.withColumn(name, F.when(F.col("_held"), labels[0]).otherwise(labels[1])).select(*df.columns, name)


def carve_validation(df: DataFrame, key: str, p: float = 0.2, seed: int = 43) -> DataFrame:
    """Turn a share of the train rows into validation rows; test stays as it is.

    The draw is stratified by ``split`` and then used inside train only, so the
    table is read as it stands, without taking it apart.
    """
    drawn = hash_holdout(df, key, p, seed, ["split"], "_drawn", ("valid", "train"))
    split = F.when(F.col("split") == "train", F.col("_drawn")).otherwise(F.col("split"))
    return drawn.withColumn("split", split).drop("_drawn")


def assign_folds(df: DataFrame, k: int, key: str, label: str = "label", seed: int | None = None) -> DataFrame:
    """Stratified folds 0..k-1, shuffled by ``seed`` or in ``key`` order without one."""
    if seed is not None:
        ranked = hash_rank(df, key, seed, [label], "_rank")
        return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")
    count = F.count(F.lit(1))
    sizes = df.groupBy(label).agg(count.alias("n"), count.alias("_n"))
    sized = group_join(ordered_rank(df, key, [label], "_rank"), sizes, [label], [key])
    fold = F.floor((F.col("_rank") - 1) * k / F.col("_n")).cast("int")
    return sized.withColumn("fold", fold).select(*df.columns, "fold")


def nested_splits(folds: DataFrame, k: int, key: str, p: float = 0.2, seed: int = 42) -> DataFrame:
    """(key, fold, phase): the fold itself tests, the rest is train or valid.

    Fold f draws its validation rows with seed + f from the rows outside it.
    """
    runs = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    each = folds.select(key, F.col("fold").alias("_own"), runs.alias("fold"))
    each = each.withColumn("_test", F.col("_own") == F.col("fold"))
    drawn = hash_holdout(each, key, p, F.col("fold") + seed, ["fold", "_test"], "_drawn", ("valid", "train"))
    phase = F.when(F.col("_test"), "test").otherwise(F.col("_drawn"))
    return drawn.select(key, "fold", phase.alias("phase"))


def split_overlap(df: DataFrame, content: str, split: str = "split") -> DataFrame:
    """Content found in more than one split, by digest."""
    once = df.groupBy(F.md5(content).alias("content_key"), F.col(split).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        once.groupBy("content_key")
        .agg(F.count(F.lit(1)).alias("splits"), F.sum("_n").alias("rows"))
        .where("splits > 1")
    )


def preview(df: DataFrame, key: str, offset: int, n: int) -> DataFrame:
    """Rows by position in ``key`` order."""
    return df.orderBy(key).offset(offset).limit(n)


def profile(df: DataFrame, split: str = "split") -> DataFrame:
    """Row count per split and the column count."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("columns", F.lit(len(df.columns)))
