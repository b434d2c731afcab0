"""Duplicates, splits, folds and counts."""

from pyspark.sql import functions as F

from defectlab import fixtures as fx
from defectlab.catalog.changes import SIDES
from defectlab.catalog.registry import PATCHES, SCRIPTS, clean_sql, holdout_sql, query
from defectlab.operators import changes as ch
from defectlab.operators import examples as ex
from defectlab.session import cut_lineage

CLEAN = f"""{PATCHES}, {SIDES},
cleaned AS (SELECT doc_id, {clean_sql('deleted_lines')} AS deleted_lines, {clean_sql('added_lines')} AS added_lines FROM sides)"""


def _pairs(spark, sf):
    return ex.clean_pairs(ch.change_pairs(fx.patches(spark, sf).drop("source", "lang")))


def _docs(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", "lang")


@query(
    "a1_dedup",
    f"""WITH {CLEAN} SELECT min(doc_id) AS doc_id, md5(deleted_lines) AS deleted_lines, md5(added_lines) AS added_lines
    FROM cleaned GROUP BY cleaned.deleted_lines, cleaned.added_lines""",
)
def a1_dedup(spark, sf):
    unique = ex.dedup_pairs(_pairs(spark, sf), "doc_id")
    return unique.select("doc_id", *[F.md5(c).alias(c) for c in ("deleted_lines", "added_lines")])


@query(
    "f7_examples",
    f"""WITH {CLEAN} SELECT doc_id, label, md5(code) AS code FROM (SELECT doc_id, deleted_lines AS code, 1 AS label FROM cleaned
    UNION ALL SELECT doc_id, added_lines, 0 FROM cleaned) WHERE code <> ''""",
)
def f7_examples(spark, sf):
    return ex.to_examples(_pairs(spark, sf), ["doc_id"]).select("doc_id", "label", F.md5("code").alias("code"))


@query("a2_holdout", f"SELECT doc_id, split FROM ({holdout_sql('documents', 'doc_id', 0.3, '42')})")
def a2_holdout(spark, sf):
    return ex.holdout(_docs(spark, sf), 0.3, 42, "doc_id").select("doc_id", "split")


@query(
    "a3_stratified_holdout",
    f"WITH {SCRIPTS} SELECT script_id, label, split FROM ({holdout_sql('scripts', 'script_id', 0.2, '42', 'label')})",
)
def a3_stratified_holdout(spark, sf):
    labelled = fx.scripts(spark, sf).select("script_id", "label")
    return ex.holdout(labelled, 0.2, 42, "script_id", ["label"])


CARVED = f"""first AS ({holdout_sql('documents', 'doc_id', 0.3, '42')}),
drawn AS (SELECT doc_id, text, split, row_number() OVER (PARTITION BY split ORDER BY md5('43:' || doc_id), doc_id) AS rn,
  count(*) OVER (PARTITION BY split) AS n FROM first),
carved AS (SELECT doc_id, text, CASE WHEN split = 'test' THEN 'test' WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END
  AS split FROM drawn)"""


def _carved(spark, sf, *cols):
    docs = fx.texts(spark, sf).select("doc_id", *cols)
    return ex.carve_validation(ex.holdout(docs, 0.3, 42, "doc_id"), "doc_id")


@query("a4_validation", f"WITH {CARVED} SELECT doc_id, split FROM carved")
def a4_validation(spark, sf):
    return _carved(spark, sf)


@query(
    "a5_folds_shuffled",
    f"""WITH {SCRIPTS} SELECT script_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || script_id), script_id)
    - 1) % 8)::INTEGER AS fold FROM scripts""",
)
def a5_folds_shuffled(spark, sf):
    return ex.assign_folds(fx.scripts(spark, sf).select("script_id", "label"), 8, "script_id", seed=42)


@query(
    "a5_folds_ordered",
    f"""WITH {SCRIPTS} SELECT script_id, label, ((row_number() OVER (PARTITION BY label ORDER BY script_id) - 1) * 10
    // count(*) OVER (PARTITION BY label))::INTEGER AS fold FROM scripts""",
)
def a5_folds_ordered(spark, sf):
    return ex.assign_folds(fx.scripts(spark, sf).select("script_id", "label"), 10, "script_id")


@query(
    "a6_nested_splits",
    f"""WITH {SCRIPTS}, folds AS (SELECT script_id, ((row_number() OVER (PARTITION BY label
      ORDER BY md5('42:' || script_id), script_id) - 1) % 8)::INTEGER AS own FROM scripts),
    each AS (SELECT script_id, own, unnest(range(0, 8))::INTEGER AS fold FROM folds),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY fold, own = fold ORDER BY md5((42 + fold) || ':' || script_id), script_id)
      AS rn, count(*) OVER (PARTITION BY fold, own = fold) AS n FROM each)
    SELECT script_id, fold, CASE WHEN own = fold THEN 'test' WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'valid' ELSE 'train' END
      AS phase FROM drawn""",
)
def a6_nested_splits(spark, sf):
    folds = ex.assign_folds(fx.scripts(spark, sf).select("script_id", "label"), 8, "script_id", seed=42)
    return ex.nested_splits(folds, 8, "script_id")


@query(
    "a7_split_overlap",
    f"""WITH {CARVED} SELECT md5(text) AS content_key, count(DISTINCT split) AS splits, count(*) AS rows FROM carved
    GROUP BY md5(text) HAVING count(DISTINCT split) > 1""",
)
def a7_split_overlap(spark, sf):
    return ex.split_overlap(_carved(spark, sf, "text"), "text")


def _grouped(spark, sf):
    docs = fx.texts(spark, sf).select("doc_id", "text")
    return ex.grouped_holdout(docs, 0.3, 42, F.col("text"))


@query("a7_grouped_overlap", "SELECT md5(text) AS content_key, 2::BIGINT AS splits, count(*) AS rows FROM documents WHERE false GROUP BY text")
def a7_grouped_overlap(spark, sf):
    """Equal contents in both parts of a split by content: none."""
    return ex.split_overlap(_grouped(spark, sf), "text")


@query(
    "a2_grouped_sizes",
    """SELECT split, rows, (SELECT count(DISTINCT text) FROM documents) AS contents
    FROM (SELECT 'test' AS split, ceil(0.3::DOUBLE * count(*))::BIGINT AS rows FROM documents
      UNION ALL SELECT 'train', count(*) - ceil(0.3::DOUBLE * count(*))::BIGINT FROM documents)""",
)
def a2_grouped_sizes(spark, sf):
    """Rows of both parts of a split by content, and the contents of the two together."""
    split = cut_lineage(_grouped(spark, sf).select("split", F.md5("text").alias("content")))
    contents = split.groupBy("split", "content").agg(F.count(F.lit(1)).alias("n"))
    whole = contents.count()
    return contents.groupBy("split").agg(F.sum("n").alias("rows")).withColumn("contents", F.lit(whole).cast("long"))


@query("a8_preview", "SELECT doc_id, lang, md5(text) AS text FROM documents ORDER BY doc_id LIMIT 5 OFFSET 9")
def a8_preview(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return ex.preview(docs, "doc_id", 9, 5).withColumn("text", F.md5("text"))


@query(
    "g12_profile",
    f'WITH {CARVED} SELECT split, count(*) AS rows, 3 AS "columns" FROM carved GROUP BY split',
)
def g12_profile(spark, sf):
    return ex.profile(_carved(spark, sf, "text"))
