"""Classification metrics as distributed aggregations.

All functions take ``label`` and ``prediction`` (0/1) or ``score`` columns and
an optional ``by`` list to report per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.plans.ranks import bucket_of, running, spread_buckets
from defectlab.plans.skew import same_group_join


def align(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions joined with labels on ``example_id``, unique on both sides."""
    return predictions.join(labels, "example_id")


def alignment(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """How many examples are on both sides or on one only."""
    p = predictions.select("example_id", F.lit(1).alias("p"))
    t = labels.select("example_id", F.lit(1).alias("t"))
    return p.join(t, "example_id", "full_outer").agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("both"),
        F.count_if(F.col("t").isNull()).alias("only_predicted"),
        F.count_if(F.col("p").isNull()).alias("only_labelled"),
    )


def to_label(score: Column, rule: str = "threshold") -> Column:
    """Score to 0/1: ``threshold`` (>= 0.5), ``half_even`` rounding or ``one`` (== 1)."""
    if rule == "threshold":
        return F.when(score >= 0.5, 1).otherwise(0)
    if rule == "half_even":
        return F.rint(score).cast("int")
    if rule == "one":
        return F.when(score == 1, 1).otherwise(0)
    raise ValueError(f"unknown rule {rule!r}")


def argmax_label(score0: Column, score1: Column) -> Column:
    """The class with the larger score; a tie goes to 0."""
    return F.when(score1 > score0, 1).otherwise(0)


def confusion(df: DataFrame) -> DataFrame:
    """Counts per (label, prediction) with ``All`` margins.

    Pairs are counted first, so the cube only works on the distinct pairs.
    """
    pairs = df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("_n"))

    def shown(c: str) -> Column:
        return F.when(F.grouping(c) == 1, "All").otherwise(F.col(c).cast("string"))

    cells = pairs.cube("label", "prediction").agg(
        F.sum("_n").alias("n"), shown("label").alias("actual"), shown("prediction").alias("predicted")
    )
    return cells.select("actual", "predicted", "n")


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under == 0, F.lit(0.0)).otherwise(over / under)


def cells(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn in one pass."""
    hit = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return df.groupBy(*(by or [])).agg(
        *[
            F.count_if((F.col("label") == a) & (F.col("prediction") == p)).cast("double").alias(name)
            for name, (a, p) in hit.items()
        ]
    )


def binary_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1, accuracy, hard_auc and mcc of class 1; 0/0 counts 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return cells(df, by).select(
        *(by or []),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).alias("hard_auc"),
        _ratio(tp * tn - fp * fn, root).alias("mcc"),
    )


def score_curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per distinct score, from the highest down: own and running counts.

    NaN scores stand below all numbers and NULL scores below these, whatever
    the size of the table.
    ``pos``/``neg`` are the score's own labels, ``tp``/``fp`` all at or above it.
    """
    by = by or []
    ranged = spread_buckets(df.select(*by, "label", (-F.col("score")).alias("_down")), "_down", nulls_last=True)
    counted = ranged.groupBy(*by, *bucket_of(ranged), "_down").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    curve = running(counted, by, [F.col("_down").asc_nulls_last()], sums={"tp": F.col("pos"), "fp": F.col("neg")})
    return curve.select(*by, (-F.col("_down")).alias("score"), "pos", "neg", "tp", "fp")


def ranking_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """auc (ties count half; NULL with one class) and average precision (0 without positives)."""
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    found = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return score_curve(df, by).groupBy(*(by or [])).agg(
        F.when((pos > 0) & (neg > 0), won / (pos * neg)).alias("auc"),
        F.when(pos > 0, found / pos).otherwise(F.lit(0.0)).alias("average_precision"),
    )


def roc_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranking_metrics(df, by).drop("average_precision")


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranking_metrics(df, by).drop("auc")


def hard_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC AUC of hard labels: the mean of both classes' recall."""
    return binary_metrics(df, by).select(*(by or []), "hard_auc")


def mcc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return binary_metrics(df, by).select(*(by or []), "mcc")


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class, with accuracy and both means."""
    pairs = df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("c"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    sums = pairs.select(F.inline(sides)).groupBy("c").agg(
        *[F.sum(x).alias(x) for x in ("support", "predicted", "tp")]
    )
    per_class = sums.select(
        F.col("c").cast("string").alias("class"),
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )
    scores = ("precision", "recall", "f1")
    support = F.sum("support")
    share = F.sum("tp") / support
    means = {
        "accuracy": [share for _ in scores],
        "macro avg": [F.avg(m) for m in scores],
        "weighted avg": [F.sum(F.col(m) * F.col("support")) / support for m in scores],
    }
    rows = [
        F.struct(F.lit(name).alias("class"), *[v.alias(m) for v, m in zip(made, scores)], support.alias("support"))
        for name, made in means.items()
    ]
    summary = per_class.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return per_class.drop("tp").unionByName(summary)


def fold_metrics(df: DataFrame, by: tuple[str, ...] = ("fold", "phase")) -> DataFrame:
    """All binary and ranking metrics per fold and phase."""
    keys = list(by)
    hard = binary_metrics(df, keys).drop("hard_auc", "mcc")
    return same_group_join(hard, roc_auc(df, keys), keys)
