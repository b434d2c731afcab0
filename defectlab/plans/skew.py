"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectlab.session import cut_lineage

# Keys with more rows than this are split up; there are at most rows / HOT_ROWS of them.
HOT_ROWS = 1_000_000
# Rows of the sample that names the keys worth counting.
SAMPLE_ROWS = 10_000_000

# A summary table is broadcast up to this size, and joined otherwise.
SMALL_ROWS = 500_000
SMALL_BYTES = 64 << 20
FEW_GROUPS = 10_000


def bounded_rows(df: DataFrame, most: int) -> list[Row] | None:
    """The rows of a small summary, or None when it has more than ``most``."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def skew_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    weights: DataFrame | None = None,
) -> DataFrame:
    """Equi-join ``facts`` with ``dim`` (unique on ``on``) without hot partitions.

    Hot keys are looked up in ``weights`` (``on`` + ``n``: fact rows per key).
    When that is not given, a table of no more than HOT_ROWS rows is joined as it
    is; of a larger one a sample names the keys that may be hot, and only these
    are counted. Without a hot key this is a plain join. Otherwise the fact rows
    of hot keys are split by a hash of ``spread`` into pieces of about HOT_ROWS,
    and only their ``dim`` rows are repeated, once per piece. Supports inner,
    left, left_semi and left_anti.
    """
    if weights is None:
        weights = _likely_hot(facts, on)
        if weights is None:
            return facts.join(dim, on, how)
    heavy = weights.select(*on, "n").where(F.col("n") > HOT_ROWS)
    hot = heavy.collect()
    if not hot:
        return facts.join(dim, on, how)
    marks = [(*r[:-1], -(-r["n"] // HOT_ROWS)) for r in hot]
    fields = [*heavy.schema.fields[:-1], T.StructField("_pieces", T.LongType())]
    known = facts.sparkSession.createDataFrame(marks, T.StructType(fields))
    pieces = F.coalesce("_pieces", F.lit(1))
    salted = _with_pieces(facts, known, on).withColumn("_salt", F.pmod(F.xxhash64(*spread), pieces))
    repeated = _with_pieces(dim, known, on).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    return salted.drop("_pieces").join(repeated.drop("_pieces"), [*on, "_salt"], how).drop("_salt")


def _likely_hot(facts: DataFrame, on: list[str]) -> DataFrame | None:
    """Exact row counts of the keys that a sample shows often; None for a table too small to have one."""
    rows = facts.count()
    if rows <= HOT_ROWS:
        return None
    share = min(1.0, SAMPLE_ROWS / rows)
    keys = facts.select(*on)
    drawn = keys.sample(share, seed=1) if share < 1 else keys
    often = drawn.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS * share / 2).drop("_n")
    known = facts.sparkSession.createDataFrame(often.collect(), often.schema)  # 2 * rows / HOT_ROWS keys at most
    return same_group_join(keys, F.broadcast(known), on, "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


def same_group_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys meet, as they do in grouping."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(named, same, how).drop(*[f"_on_{c}" for c in on])


def group_key(by: list[str]) -> Column:
    """One value per group that is never NULL."""
    return F.to_json(F.struct(*by))


def _with_pieces(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Attach the piece count of hot keys; at most rows / HOT_ROWS of them are broadcast."""
    return same_group_join(df, F.broadcast(known), on, "left")


def small_enough(table: DataFrame, texts: list[str]) -> bool:
    """Whether a written table may be broadcast, by its rows and the bytes of its text columns."""
    text = sum((F.octet_length(F.col(c).cast("string")) for c in texts), F.lit(0))
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= SMALL_ROWS and size["bytes"] <= SMALL_BYTES


def summary_join(facts: DataFrame, summary: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """Inner join with a per-key summary of the facts themselves.

    ``summary`` holds ``on``, the fact rows per key ``n`` (not returned) and the
    values to attach. It is worked out once and written to the shared folder;
    then its real size decides between a broadcast and a split-up join.
    """
    ready = cut_lineage(summary)
    if small_enough(ready, on):
        return facts.join(F.broadcast(ready.drop("n")), on)
    return skew_join(facts, ready.drop("n"), on, "inner", spread, ready.select(*on, "n"))


def group_join(facts: DataFrame, summary: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """Inner join with a summary per class, fold or model; ``n`` as in summary_join.

    Such groups are few as a rule, so their rows are fetched and broadcast; when
    there are more than FEW_GROUPS the general way is taken. NULL is a group.
    """
    rows = bounded_rows(summary, FEW_GROUPS)
    if rows is not None:
        known = facts.sparkSession.createDataFrame(rows, summary.schema)
        return same_group_join(facts, F.broadcast(known.drop("n")), on)
    keyed = facts.withColumn("_group", group_key(on))
    return summary_join(keyed, summary.withColumn("_group", group_key(on)).drop(*on), ["_group"], spread).drop("_group")
