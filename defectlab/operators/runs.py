"""Summaries over repeated runs and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlab.plans.ranks import bucket_of, running, spread_buckets
from defectlab.plans.skew import bounded_rows, group_join, same_group_join
from defectlab.session import cut_lineage
from defectlab.sources.writers import METRICS

MANY_MODELS = 10_000


def median(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact interpolated median per group by position.

    Equal values are counted first and positions come from running counts, so
    no group's values are gathered in one place.
    """
    keyed = values.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ranged = spread_buckets(keyed, "_v")
    counted = ranged.groupBy(*by, *bucket_of(ranged), "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counted, by, [F.col("_v")], sums={"_upto": F.col("_n")})
    count = F.count(F.lit(1))
    sizes = keyed.groupBy(*by).agg(count.alias("n"), count.alias("_size"))
    low, high = F.expr("(_size + 1) div 2"), F.expr("_size div 2 + 1")
    near = group_join(placed, sizes, by, ["_v"])
    first = F.col("_upto") - F.col("_n") + 1

    def covers(place):
        return (first <= place) & (place <= F.col("_upto"))

    picked = near.where(covers(low) | covers(high))
    at_low = F.max(F.when(covers(low), F.col("_v")))
    at_high = F.max(F.when(covers(high), F.col("_v")))
    return picked.groupBy(*by).agg(((at_low + at_high) / 2).alias("median"))


def summarize_runs(runs: DataFrame, by: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Mean, median, max and min of every metric per group."""
    by = by or ["model"]
    long = runs.unpivot(by, metrics or METRICS, "metric", "value")
    keys = [*by, "metric"]
    basic = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))
    return same_group_join(basic, median(long, keys, "value"), keys, "left")


def compare(runs: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Mean of every metric per model, and whether the model is best at it."""
    metrics = metrics or METRICS
    means = runs.groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics])
    # Means are fixed once, so that "best" compares identical values.
    few = bounded_rows(means, MANY_MODELS)
    means = cut_lineage(means) if few is None else runs.sparkSession.createDataFrame(few, means.schema)
    tops = {m: means.agg(F.max(m)).scalar() for m in metrics}
    return means.select("model", *metrics, *[(F.col(m) == tops[m]).alias(f"best_{m}") for m in metrics])


def best_epoch(log: DataFrame, by: str = "fold", epoch: str = "epoch", value: str = "acc", patience: int = 4) -> DataFrame:
    """Where training stops and which epoch it keeps.

    An evaluation that beats all before it is a gain; training stops at the
    first one that is ``patience`` evaluations past the last gain. Ties keep
    the earlier epoch.
    """
    placed = spread_buckets(log.select(by, epoch, value), epoch)
    first = running(
        placed, [by], [F.col(epoch)], sums={"idx": F.lit(1).cast("long")}, max_before={"_best": F.col(value)}
    )
    gain = F.col("_best").isNull() | (F.col(value) > F.col("_best"))
    mark = F.when(gain, F.struct(F.col("idx"), F.col(epoch).alias("epoch"), F.col(value).alias("value")))
    second = running(first.withColumn("_mark", mark), [by], [F.col(epoch)], maxes={"last": F.col("_mark")})
    stalled = F.col("idx") - F.col("last.idx") >= patience
    state = F.struct(F.col("idx"), F.col(epoch).alias("at"), F.col("last"))
    ends = second.groupBy(by).agg(F.min(F.when(stalled, state)).alias("stop"), F.max(state).alias("end"))
    final = F.coalesce("stop", "end")
    return ends.select(
        by,
        final["last"]["epoch"].alias("best_epoch"),
        final["last"]["value"].alias("best_value"),
        final["at"].alias("stop_epoch"),
    )
