"""Classification metrics, run summaries and training logs."""

from pyspark.sql import functions as F

from defectlab import fixtures as fx
from defectlab.catalog.registry import PREDICTIONS, RUNS, query
from defectlab.operators import metrics as mt
from defectlab.operators import runs as rn
from defectlab.session import cut_lineage
from defectlab.sources import runs_long


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


CELLS = """cells AS (SELECT count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp,
  count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn,
  count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS tn FROM predictions)"""


def _div(a, b):
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


def _auc(rows, by=""):
    """AUC as the share of (positive, negative) pairs ordered rightly, ties half, from ranks."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {keys}(sum(r) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)) AS auc
      FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {keys} score) - 1) / 2.0::DOUBLE AS r,
        (count(*) FILTER (label = 1) OVER ({part}))::DOUBLE AS p, (count(*) FILTER (label = 0) OVER ({part}))::DOUBLE AS q FROM {rows}) {group})"""


@query(
    "j5_align",
    """SELECT d.doc_id AS example_id, (d.doc_id * 37 % 101) / 100.0::DOUBLE AS score, quality AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def j5_align(spark, sf):
    return mt.align(_scores(spark, sf), _labels(spark, sf))


@query(
    "j5_alignment",
    """SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS both,
    count(*) FILTER (l.doc_id IS NULL) AS only_predicted, count(*) FILTER (d.doc_id IS NULL) AS only_labelled
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def j5_alignment(spark, sf):
    return mt.alignment(_scores(spark, sf), _labels(spark, sf))


def _scores(spark, sf):
    score = (F.col("doc_id") * 37 % 101) / F.lit(100.0)
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), score.alias("score"))


def _labels(spark, sf):
    return fx.table(spark, sf, "labels").select(F.col("doc_id").alias("example_id"), F.col("quality").alias("label"))


@query(
    "g1_confusion",
    f"""WITH {PREDICTIONS} SELECT CASE WHEN grouping(label) = 1 THEN 'All' ELSE label::VARCHAR END AS actual,
    CASE WHEN grouping(prediction) = 1 THEN 'All' ELSE prediction::VARCHAR END AS predicted, count(*) AS n
    FROM predictions GROUP BY CUBE (label, prediction)""",
)
def g1_confusion(spark, sf):
    return mt.confusion(fx.predictions(spark, sf))


@query(
    "g2_precision_recall_f1",
    f"""WITH {PREDICTIONS}, {CELLS} SELECT round({_div('tp', 'tp + fp')}, 6) AS precision,
    round({_div('tp', 'tp + fn')}, 6) AS recall, round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM cells""",
)
def g2_precision_recall_f1(spark, sf):
    return _rounded(mt.binary_metrics(fx.predictions(spark, sf)).select("precision", "recall", "f1"))


@query(
    "g3_accuracy",
    f"WITH {PREDICTIONS} SELECT round(avg((label = prediction)::INTEGER), 6) AS accuracy FROM predictions",
)
def g3_accuracy(spark, sf):
    return _rounded(mt.binary_metrics(fx.predictions(spark, sf)).select("accuracy"))


@query("g4_roc_auc", f"WITH {PREDICTIONS} SELECT round(auc, 6) AS auc FROM {_auc('predictions')}")
def g4_roc_auc(spark, sf):
    return _rounded(mt.roc_auc(fx.predictions(spark, sf)))


@query(
    "g5_hard_auc",
    f"WITH {PREDICTIONS}, {CELLS} SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS hard_auc FROM cells",
)
def g5_hard_auc(spark, sf):
    return _rounded(mt.hard_auc(fx.predictions(spark, sf)))


@query(
    "g6_average_precision",
    f"""WITH {PREDICTIONS}, byscore AS (SELECT score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM predictions GROUP BY score),
    run AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM byscore WINDOW w AS (ORDER BY score DESC))
    SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM run""",
)
def g6_average_precision(spark, sf):
    return _rounded(mt.average_precision(fx.predictions(spark, sf)))


@query(
    "g7_mcc",
    f"""WITH {PREDICTIONS}, {CELLS} SELECT round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp)
    * sqrt(tn + fn)), 6) AS mcc FROM cells""",
)
def g7_mcc(spark, sf):
    return _rounded(mt.mcc(fx.predictions(spark, sf)))


@query(
    "g8_class_report",
    f"""WITH {PREDICTIONS}, classes AS (SELECT DISTINCT unnest([label, prediction]) AS c FROM predictions),
    counts AS (SELECT c, (SELECT count(*) FROM predictions WHERE label = c) AS support,
      (SELECT count(*) FROM predictions WHERE prediction = c) AS predicted,
      (SELECT count(*) FROM predictions WHERE label = c AND prediction = c) AS tp FROM classes),
    per AS (SELECT c::VARCHAR AS class, {_div('tp', 'predicted')} AS precision, {_div('tp', 'support')} AS recall,
      {_div('2.0 * tp', 'predicted + support')} AS f1, support, tp FROM counts),
    report AS (SELECT class, precision, recall, f1, support FROM per
      UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM per
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM per)
    SELECT class, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1,
      support::BIGINT AS support FROM report""",
)
def g8_class_report(spark, sf):
    report = mt.class_report(fx.predictions(spark, sf))
    return _rounded(report, "class", "support")


@query(
    "g9_to_label",
    f"""WITH {PREDICTIONS} SELECT example_id, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS threshold,
    round_even(score, 0)::INTEGER AS half_even, CASE WHEN score = 1 THEN 1 ELSE 0 END AS one,
    CASE WHEN score > 1 - score THEN 1 ELSE 0 END AS larger FROM predictions""",
)
def g9_to_label(spark, sf):
    score = F.col("score")
    return fx.predictions(spark, sf).select(
        "example_id",
        *[mt.to_label(score, rule).alias(rule) for rule in ("threshold", "half_even", "one")],
        mt.argmax_label(1 - score, score).alias("larger"),
    )


@query(
    "g11_fold_metrics",
    f"""WITH {PREDICTIONS}, byfold AS (SELECT fold, phase, count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp,
      count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn,
      avg((label = prediction)::INTEGER) AS accuracy FROM predictions GROUP BY fold, phase)
    SELECT fold, phase, round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall,
      round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, round(accuracy, 6) AS accuracy,
      round(CASE WHEN isfinite(auc) THEN auc END, 6) AS auc
    FROM byfold JOIN {_auc('predictions', 'fold, phase')} a USING (fold, phase)""",
)
def g11_fold_metrics(spark, sf):
    return _rounded(mt.fold_metrics(fx.predictions(spark, sf)), "fold", "phase")


@query(
    "g10_summary",
    f"""WITH {RUNS}, long AS (UNPIVOT runs ON auc, precision, recall, f1 INTO NAME metric VALUE v)
    SELECT model, metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(v), 6) AS max,
      round(min(v), 6) AS min FROM long GROUP BY model, metric""",
)
def g10_summary(spark, sf):
    return _rounded(rn.summarize_runs(fx.runs(spark, sf)), "model", "metric")


@query(
    "g10_phases",
    f"""WITH {PREDICTIONS}, byfold AS (SELECT fold, phase, count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp,
      count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn,
      avg((label = prediction)::INTEGER) AS accuracy FROM predictions GROUP BY fold, phase),
    folds AS (SELECT fold, phase, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,
      {_div('2 * tp', '2 * tp + fp + fn')} AS f1, accuracy, CASE WHEN isfinite(auc) THEN auc END AS auc
      FROM byfold JOIN {_auc('predictions', 'fold, phase')} a USING (fold, phase)),
    long AS (UNPIVOT folds ON accuracy, auc, precision, recall, f1 INTO NAME metric VALUE v)
    SELECT phase, metric, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(v), 6) AS max, round(min(v), 6) AS min
    FROM long GROUP BY phase, metric""",
)
def g10_phases(spark, sf):
    """Folds summarised by phase, accuracy among the metrics."""
    folds = cut_lineage(mt.fold_metrics(fx.predictions(spark, sf)))
    found = rn.summarize_runs(folds, ["phase"], ["accuracy", "auc", "precision", "recall", "f1"])
    return _rounded(found.where("mean IS NOT NULL"), "phase", "metric")


@query(
    "m11_compare",
    f"""WITH {RUNS}, means AS (SELECT model, avg(auc) AS auc, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1
      FROM runs GROUP BY model)
    SELECT model, round(auc, 6) AS auc, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      auc = max(auc) OVER () AS best_auc, precision = max(precision) OVER () AS best_precision,
      recall = max(recall) OVER () AS best_recall, f1 = max(f1) OVER () AS best_f1 FROM means""",
)
def m11_compare(spark, sf):
    table = rn.compare(fx.runs(spark, sf))
    best = [c for c in table.columns if c.startswith("best_")]
    return _rounded(table, "model", *best)


@query(
    "k3_runs_long",
    f"""WITH {RUNS}, long AS (UNPIVOT runs ON auc, precision, recall, f1 INTO NAME metric VALUE v)
    SELECT model, run, metric, round(v, 6) AS value FROM long""",
)
def k3_runs_long(spark, sf):
    return runs_long(fx.runs(spark, sf)).withColumn("value", F.round("value", 6))


@query(
    "m10_best_epoch",
    """WITH logs AS (SELECT label AS fold, vec_id AS epoch, (vec_id * 37 % 101) / 101.0::DOUBLE AS acc,
      row_number() OVER (PARTITION BY label ORDER BY vec_id) AS idx FROM embeddings),
    gains AS (SELECT *, acc > coalesce(max(acc) OVER (PARTITION BY fold ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), -1) AS gain FROM logs),
    lasts AS (SELECT *, max(CASE WHEN gain THEN idx END) OVER (PARTITION BY fold ORDER BY idx) AS last FROM gains),
    stops AS (SELECT fold, coalesce(min(CASE WHEN idx - last >= 4 THEN idx END), max(idx)) AS stop FROM lasts GROUP BY fold)
    SELECT s.fold, b.epoch AS best_epoch, round(b.acc, 6) AS best_value, e.epoch AS stop_epoch
    FROM stops s JOIN lasts e ON e.fold = s.fold AND e.idx = s.stop JOIN lasts b ON b.fold = s.fold AND b.idx = e.last""",
)
def m10_best_epoch(spark, sf):
    return rn.best_epoch(fx.eval_log(spark, sf)).withColumn("best_value", F.round("best_value", 6))
