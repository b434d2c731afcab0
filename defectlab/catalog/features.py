"""Term features."""

from pyspark.sql import functions as F

from defectlab import fixtures as fx
from defectlab.catalog.registry import POSTINGS, query
from defectlab.functions.text import terms
from defectlab.operators import features as ft
from defectlab.session import cut_lineage, scratch_path
from defectlab.sources import matrix_long, read_matrix


def _postings(spark, sf):
    return ft.postings(fx.texts(spark, sf).select("doc_id", "text"), "doc_id", "text")


def _frequency(spark, sf):
    return ft.document_frequency(fx.texts(spark, sf).select("text"), "text")


def _rows(spark, sf):
    return fx.table(spark, sf, "documents").count()


TOP = "top AS (SELECT term, count(*) AS df FROM postings GROUP BY term ORDER BY df DESC, term LIMIT 1000)"


@query("m1_bow", f"WITH {POSTINGS}, {TOP} SELECT doc_id, term, tf FROM postings SEMI JOIN top USING (term)")
def m1_bow(spark, sf):
    return ft.bag_of_words(fx.texts(spark, sf).select("doc_id", "text"), "doc_id", "text", 1000).select("doc_id", "term", "tf")


@query("m1_postings", f"WITH {POSTINGS} SELECT doc_id, term, tf FROM postings")
def m1_postings(spark, sf):
    return _postings(spark, sf)


@query("a9_vocabulary", f"WITH {POSTINGS}, {TOP} SELECT term, df FROM top")
def a9_vocabulary(spark, sf):
    return ft.vocabulary(_frequency(spark, sf), 1000)


@query(
    "m2_tfidf",
    f"""WITH {POSTINGS}, dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)
    SELECT doc_id, term, tf, round(tf * ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (df + 1)), 6) AS weight
    FROM postings JOIN dfs USING (term)""",
)
def m2_tfidf(spark, sf):
    posts = cut_lineage(_postings(spark, sf))
    weighted = ft.tf_idf(posts, ft.posting_frequency(posts), _rows(spark, sf))
    return weighted.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


STATS = """n AS (SELECT count(*)::DOUBLE AS n FROM documents),
stats AS (SELECT term, sum(tf) / any_value(n) AS mu,
  sqrt((count(*) * var_pop(tf) + avg(tf) * avg(tf) * count(*) * (any_value(n) - count(*)) / any_value(n)) / any_value(n)) AS sd
  FROM cells, n GROUP BY term),
scaled AS (SELECT term, mu, CASE WHEN sd <= 1e-12 * abs(mu) THEN 1.0 ELSE sd END AS sd FROM stats)"""

# A term of large values next to each other stands beside the counts.
CELLS = """cells AS (SELECT doc_id, term, tf::DOUBLE AS tf FROM postings
  UNION ALL SELECT doc_id, '#chars', 100000000 + n_chars FROM documents)"""


def _cells(spark, sf):
    large = (F.col("n_chars") + 100_000_000).cast("long").alias("tf")
    return _postings(spark, sf).unionByName(fx.table(spark, sf, "documents").select("doc_id", F.lit("#chars").alias("term"), large))


@query(
    "m3_scale",
    f"""WITH {POSTINGS}, {CELLS}, {STATS} SELECT doc_id, term, round((tf - mu) / sd, 6) AS z FROM cells JOIN scaled USING (term)""",
)
def m3_scale(spark, sf):
    return ft.scale(cut_lineage(_cells(spark, sf)), _rows(spark, sf)).select("doc_id", "term", F.round("z", 6).alias("z"))


@query(
    "m3_scale_stats",
    f"""WITH {POSTINGS}, {CELLS}, {STATS} SELECT term, round(mu, 6) AS mu, round(sd, 6) AS sd, round(-mu / sd, 4) AS z_of_zero
    FROM scaled""",
)
def m3_scale_stats(spark, sf):
    stats = ft.scale_stats(_cells(spark, sf), _rows(spark, sf))
    return stats.select("term", *[F.round(c, d).alias(c) for c, d in (("mu", 6), ("sd", 6), ("z_of_zero", 4))])


@query(
    "f8_select",
    f"""WITH {POSTINGS}, chosen AS (SELECT term FROM postings GROUP BY term HAVING sum(tf) > count(*))
    SELECT doc_id, term, tf FROM postings SEMI JOIN chosen USING (term)""",
)
def f8_select(spark, sf):
    """Terms that occur more than once in some document."""
    posts = cut_lineage(_postings(spark, sf))
    counts = cut_lineage(posts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("n")))
    chosen = counts.where("tf > n")
    return ft.select_features(posts, chosen, weights=chosen.select("term", "n")).select("doc_id", "term", "tf")


@query(
    "s7_matrix",
    r"""WITH cells AS (SELECT d.doc_id, quality AS label, n_chars::DOUBLE AS c, length(text)::DOUBLE AS t,
      len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> ''))::DOUBLE AS w
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id, label, 0 AS feature, c AS value FROM cells UNION ALL SELECT doc_id, label, 1, t FROM cells
    UNION ALL SELECT doc_id, label, 2, w FROM cells""",
)
def s7_matrix(spark, sf):
    docs = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id")
    dense = docs.select(
        "doc_id", F.col("quality").alias("label"), F.col("source").alias("skipped"), "n_chars",
        F.length("text").alias("length"), F.size(terms(F.col("text"))).alias("terms"),
    )
    path = scratch_path(spark, "matrix")
    dense.write.option("header", True).csv(path)
    cells = matrix_long(read_matrix(spark, path))
    return cells.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "feature", "value")
