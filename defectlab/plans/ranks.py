"""Exact ranks, running values and split points without a one-task sort.

Rows are put into ordered buckets first; per-bucket totals form a small table
whose running sum gives every bucket its offset, and only rows of one bucket
are ever sorted together.
"""

from __future__ import annotations

import math
import os
from collections.abc import Mapping

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectlab.plans.skew import bounded_rows, group_key, same_group_join, summary_join

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 8192
SAMPLES_PER_BUCKET = 200
TELLING_BYTES = 6
HASH_DIGITS = 3
BUCKET = "_bucket"
NO_KEY = "\u0000"
HISTOGRAM_ROWS = 200_000
BOUNDARY_ROWS = 500_000
TWINS_PER_BLOCK = 100_000


def seeded_hash(seed: int | Column, key: str) -> Column:
    """Placement of a row that depends on the seed and its key only; NULL is a key like any other."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY))))


def spread_buckets(df: DataFrame, key: str, nulls_last: bool = False) -> DataFrame:
    """Add ``_bucket``: ranges of ``key`` holding about equally many rows.

    Small inputs stay as they are and are ranked as one. For others the range
    limits come from a sample of bounded size: they only steer how even the
    buckets are, every row gets its place whatever they are. Buckets rise as
    Spark sorts: NaN above all numbers, NULL in a bucket of its own, the first
    or, with ``nulls_last``, the last.
    """
    rows = df.count()
    parts = min(MAX_BUCKETS, math.ceil(rows / ROWS_PER_BUCKET))
    if parts <= 1:
        return df
    valued = df.withColumn("_value", _as_number(df, key))
    shares = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    drawn = valued.select("_value").where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    drawn = drawn.sample(min(1.0, SAMPLES_PER_BUCKET * parts / rows), seed=1)
    limits = drawn.agg(F.expr(f"percentile_approx(_value, array({shares}), {20 * parts})").alias("at")).first()["at"]
    plain = F.col("_value").isNotNull() & ~F.isnan("_value")
    inner = sorted({x for x in limits or [] if math.isfinite(x)})
    cutter = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="_plain", outputCol=BUCKET, handleInvalid="keep")
    cut = cutter.transform(valued.withColumn("_plain", F.when(plain, F.col("_value")).otherwise(F.lit(0.0))))
    above = float(len(inner) + 2)
    place = F.when(F.col("_value").isNull(), F.lit(above + 1 if nulls_last else -1.0)).when(plain, F.col(BUCKET)).otherwise(F.lit(above))
    return cut.withColumn(BUCKET, place).drop("_value", "_plain")


def _as_number(df: DataFrame, key: str) -> Column:
    """A number that never falls while ``key`` rises.

    Of a text it is made from the bytes after the prefix that the smallest and
    the largest value share, because all values in between share it too.
    """
    kind = df.schema[key].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(F.col(key), "UTC")).cast("double")
    if not isinstance(kind, T.StringType):
        return F.col(key).cast("double")
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    shared = os.path.commonprefix([ends["low"] or "", ends["high"] or ""]).encode()
    telling = F.substring(F.encode(key, "UTF-8"), len(shared) + 1, TELLING_BYTES)
    return F.conv(F.rpad(F.hex(telling), 2 * TELLING_BYTES, "0"), 16, 10).cast("double")


def bucket_of(df: DataFrame) -> list[str]:
    """The bucket column as a grouping key, if there is one."""
    return [BUCKET] if BUCKET in df.columns else []


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column | str],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    max_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running sums and maxima inside ``by`` along ``order``.

    ``sums`` and ``maxes`` include the row itself, ``max_before`` does not. Where
    ``df`` has buckets, they have to rise with ``order``.
    """
    sums, maxes, max_before = dict(sums or {}), dict(maxes or {}), dict(max_before or {})
    values = {**sums, **maxes, **max_before}
    bucketed = BUCKET in df.columns
    columns = df.columns
    if bucketed:
        df, by = df.withColumn("_group", group_key(by) if by else F.lit("")), ["_group"]
    keys = [*by, *bucket_of(df)]
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    keyed = df.select("*", *[c.alias(f"_v_{name}") for name, c in values.items()])
    local = {
        **{n: F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) for n in sums},
        **{n: F.max(f"_v_{n}").over(upto) for n in maxes},
        **{n: F.max(f"_v_{n}").over(before) for n in max_before},
    }
    if not bucketed:
        return keyed.select(*columns, *[c.alias(n) for n, c in local.items()])

    totals = keyed.groupBy(*keys).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in (*maxes, *max_before)],
    )
    earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in (*maxes, *max_before)],
    )
    return keyed.join(offsets, keys).select(
        *columns,
        *[(F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + local[n]).alias(n) for n in sums],
        *[_larger(F.col(f"_o_{n}"), local[n]).alias(n) for n in (*maxes, *max_before)],
    )


def _larger(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).when(a > b, a).otherwise(b)


def ordered_rank(df: DataFrame, key: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based rank by ``key`` inside ``by``."""
    ranked = running(spread_buckets(df, key), by or [], [F.col(key)], sums={name: F.lit(1).cast("long")})
    return ranked.drop(BUCKET)


def hash_rank(df: DataFrame, key: str, seed: int | Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based rank by the seeded hash of ``key`` inside ``by``.

    Buckets are hash prefixes, as many digits as keep one near ROWS_PER_BUCKET
    rows; offsets are one row per bucket.
    """
    digits = math.ceil(math.log(max(1, df.count() / ROWS_PER_BUCKET), 16))
    placed = df.withColumn("_hash", seeded_hash(seed, key))
    if digits:
        placed = placed.withColumn(BUCKET, F.substring("_hash", 1, digits))
    ranked = running(placed, by or [], [F.col("_hash"), F.col(key)], sums={name: F.lit(1).cast("long")})
    return ranked.drop(BUCKET, "_hash")


def hash_holdout(
    df: DataFrame,
    key: str,
    fraction: float,
    seed: int | Column,
    by: list[str] | None = None,
    name: str = "split",
    labels: tuple[str, str] = ("test", "train"),
) -> DataFrame:
    """Mark exactly ceil(n * fraction) rows per ``by`` as held out.

    The rows with the smallest seeded hashes are taken. Their last (hash, key)
    is found per group by narrowing a histogram of hash prefixes; the table
    itself is then only compared with that value, without any shuffle.

    Keys may be NULL or repeat. Where only some of the rows with the last key
    may be taken, a hash of the whole row decides in the same way; of rows that
    are equal in all columns any may stand for another, so these are written
    out anew, as many for each side as there have to be.
    """
    by = by or []
    kind = df.schema[key].dataType
    hashed = df.select(*by, F.col(key).alias("_key"), seeded_hash(seed, key).alias("_hash"))
    cuts = _cuts(hashed, by, lambda sizes: {g: math.ceil(n * fraction) for g, n in sizes.items()})
    if cuts is None:
        return _ranked_holdout(df, key, fraction, seed, by, name, labels)
    placed = F.struct(seeded_hash(seed, key).alias("h"), F.col(key).alias("k"))
    cut = lambda: F.struct(F.col("_cut_hash").alias("h"), F.col("_cut_key").cast(kind).alias("k"))
    held = F.coalesce(placed <= cut(), F.lit(False))
    marked = _with_cuts(df, cuts, by, hashed.schema)
    if all(c["_take"] == c["_same"] for c in cuts):
        return marked.withColumn(name, F.when(held, labels[0]).otherwise(labels[1])).select(*df.columns, name)

    # Some keys at the cut repeat: their rows go by a hash of the whole row.
    tied = F.coalesce((placed == cut()) & (F.col("_cut_take") < F.col("_cut_same")), F.lit(False))
    row_hash = F.md5(F.concat(F.lit("row:"), F.to_json(F.struct(*df.columns))))
    ties = marked.where(tied)
    parts = ties.select(*by, row_hash.alias("_key"), row_hash.alias("_hash"))
    wanted = {tuple(c[b] for b in by): c["_take"] for c in cuts if c["_take"] < c["_same"]}
    inner = _cuts(parts, by, lambda sizes: {g: wanted[g] for g in sizes})
    if inner is None:
        return _ranked_holdout(df, key, fraction, seed, by, name, labels)
    settled = marked.where(~tied).withColumn(name, F.when(held, labels[0]).otherwise(labels[1])).select(*df.columns, name)
    second = _with_cuts(ties.select(*df.columns), inner, by, parts.schema).withColumn("_row", row_hash)
    twins = (F.col("_row") == F.col("_cut_hash")) & (F.col("_cut_take") < F.col("_cut_same"))
    apart = second.where(~twins).withColumn(name, F.when(F.col("_row") <= F.col("_cut_hash"), labels[0]).otherwise(labels[1]))
    one = second.where(twins).groupBy("_row", "_cut_take", "_cut_same").agg(F.first(F.struct(*df.columns)).alias("r"))
    blocks = one.withColumn("_block", F.explode(F.expr(f"sequence(0, (_cut_same - 1) div {TWINS_PER_BLOCK})")))
    last = F.least(F.col("_cut_same"), (F.col("_block") + 1) * TWINS_PER_BLOCK)
    each = blocks.withColumn("_i", F.explode(F.sequence(F.col("_block") * TWINS_PER_BLOCK + 1, last)))
    copies = each.select("r.*", F.when(F.col("_i") <= F.col("_cut_take"), labels[0]).otherwise(labels[1]).alias(name))
    return settled.unionByName(apart.select(*df.columns, name)).unionByName(copies)


def _with_cuts(df: DataFrame, cuts: list[dict], by: list[str], schema: T.StructType) -> DataFrame:
    """``df`` with the cut of each row's group; one row per group is broadcast, no more than HISTOGRAM_ROWS."""
    fields = [schema[c] for c in by] + [
        T.StructField("_cut_hash", T.StringType()), T.StructField("_cut_key", schema["_key"].dataType),
        T.StructField("_cut_take", T.LongType()), T.StructField("_cut_same", T.LongType()),
    ]
    rows = [(*[c[b] for b in by], c["_hash"], c["_key"], c["_take"], c["_same"]) for c in cuts]
    if by:
        known = df.sparkSession.createDataFrame(rows, T.StructType(fields))
        return same_group_join(df, F.broadcast(known), by, "left")
    values = rows[0] if rows else (None,) * 4
    return df.select("*", *[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, fields)])


def _cuts(hashed: DataFrame, by: list[str], wanted) -> list[dict] | None:
    """Per group the (hash, key) of the last held-out row, how many rows have it and how many of them are taken.

    ``wanted`` maps group sizes to numbers of rows. None if there are too many groups.
    """
    digits = HASH_DIGITS
    counts = hashed.groupBy(*by, F.substring("_hash", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    rows = bounded_rows(counts, HISTOGRAM_ROWS)
    if rows is None:
        return None
    sizes: dict[tuple, int] = {}
    for r in rows:
        group = tuple(r[c] for c in by)
        sizes[group] = sizes.get(group, 0) + r["n"]
    need = {g: n for g, n in wanted(sizes).items() if n > 0}
    if not need:
        return []
    while True:
        need, prefix, population = _narrow(rows, by, need)
        inside = _within(hashed, by, prefix, need)
        if population <= BOUNDARY_ROWS or digits >= 32:
            break
        digits += HASH_DIGITS
        finer = inside.groupBy(*by, F.substring("_hash", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
        rows = bounded_rows(finer, HISTOGRAM_ROWS)
        if rows is None:
            return None
    # Equal keys are counted first, so that copies of one key are one row here.
    keyed = inside.groupBy(*by, "_need", "_hash", "_key").agg(F.count(F.lit(1)).alias("_same"))
    order = Window.partitionBy(*by).orderBy("_hash", "_key")
    upto = F.sum("_same").over(order.rowsBetween(Window.unboundedPreceding, 0))
    reached = keyed.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_same") < F.col("_need")))
    taken = (F.col("_need") - F.col("_upto") + F.col("_same")).alias("_take")
    return [r.asDict() for r in reached.select(*by, "_hash", "_key", taken, "_same").collect()]  # one row per group


def _narrow(rows, by, need):
    """The prefix each group's cut falls into and how many rows to take inside it."""
    grouped: dict[tuple, list] = {}
    for r in rows:
        grouped.setdefault(tuple(r[c] for c in by), []).append((r["_p"], r["n"]))
    left, prefix, population = {}, {}, 0
    for group, wanted in need.items():
        taken = 0
        for p, n in sorted(grouped[group]):
            if taken + n >= wanted:
                left[group], prefix[group] = wanted - taken, p
                population += n
                break
            taken += n
    return left, prefix, population


def _within(hashed, by, prefix, need):
    """The rows sharing the hash prefix their group's cut falls into."""
    if not by:
        return hashed.where(F.col("_hash").startswith(prefix[()])).withColumn("_need", F.lit(need[()]))
    kinds = ", ".join([*[f"`_by_{c}` {hashed.schema[c].dataType.simpleString()}" for c in by], "_pre string, _need long"])
    small = hashed.sparkSession.createDataFrame([(*g, prefix[g], need[g]) for g in need], kinds)
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    hit = F.col("_hash").startswith(F.col("_pre"))
    return hashed.join(F.broadcast(small), [*same, hit], "inner").select(*hashed.columns, "_need")


def _ranked_holdout(df, key, fraction, seed, by, name, labels):
    """The same marks by full ranks, for more groups than a summary may hold."""
    count = F.count(F.lit(1))
    keyed = df.withColumn("_group", group_key(by))
    sizes = keyed.groupBy("_group").agg(count.alias("n"), count.alias("_n"))
    joined = summary_join(hash_rank(keyed, key, seed, ["_group"], "_rank"), sizes, ["_group"], [key])
    mark = F.when(F.col("_rank") <= F.ceil(F.col("_n") * F.lit(fraction)), labels[0]).otherwise(labels[1])
    return joined.withColumn(name, mark).select(*df.columns, name)
