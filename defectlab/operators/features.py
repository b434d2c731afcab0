"""Term features: vocabulary, bag of words, TF-IDF, scaling, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.functions.stem import stem_text, stem_token
from defectlab.functions.text import collapse_blanks, term_runs, terms, word_count
from defectlab.plans.ranks import ordered_rank
from defectlab.plans.skew import skew_join, small_enough, summary_join
from defectlab.session import cut_lineage

ALL_TERMS = (1 << 31) - 1


def token_stats(df: DataFrame, text: str) -> DataFrame:
    """Longest and total token count over all rows."""
    counts = df.select(word_count(F.col(text)).alias("n"))
    return counts.agg(
        F.max("n").alias("max_tokens"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")
    )


def token_counts(df: DataFrame, text: str, split: Column | None = None) -> DataFrame:
    """Vocabulary with its occurrence counts."""
    found = split if split is not None else terms(F.col(text))
    return df.select(F.explode(found).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocab_lengths(vocabulary: DataFrame) -> DataFrame:
    """How many vocabulary entries have each length."""
    return vocabulary.groupBy(F.length("token").alias("length")).agg(F.count(F.lit(1)).alias("tokens"))


def vocab_length_range(vocabulary: DataFrame) -> DataFrame:
    size = F.length("token")
    return vocabulary.agg(
        F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.count(F.lit(1)).alias("tokens")
    )


def stem_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """(token, stem, n): each distinct token is stemmed once."""
    return vocabulary.select("token", stem_token("token").alias("stem"), "n")


def conflate(stems: DataFrame) -> DataFrame:
    """Occurrences and distinct tokens per stem."""
    return stems.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tokens"))


def stemmed(df: DataFrame, text: str, name: str = "stemmed") -> DataFrame:
    """The text with every blank-separated token stemmed; no shuffle."""
    return df.withColumn(name, stem_text(collapse_blanks(F.col(text))))


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """(term, df). Each text lists a term once, so only per-term counts are shuffled."""
    once = df.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    return once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(frequency: DataFrame, k: int, min_df: int = 1) -> DataFrame:
    """The k terms found in most rows; ties by term.

    How many terms have each count tells the count at which k is reached. All
    terms above it are taken as they are, only those at it are put in order.
    """
    ready = cut_lineage(frequency.where(F.col("df") >= min_df))
    above, cut = 0, None
    for r in ready.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).toLocalIterator():
        if above + r["n"] >= k:
            cut = r["df"]
            break
        above += r["n"]
    if cut is None:
        return ready
    ties = ordered_rank(ready.where(F.col("df") == cut), "term", name="_rank").where(F.col("_rank") <= k - above)
    return ready.where(F.col("df") > cut).unionByName(ties.drop("_rank"))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf); ``key`` names a row. Counted inside the row, nothing is shuffled."""
    runs = df.select(key, F.explode(term_runs(F.col(text))).alias("_run"))
    named = runs.withColumn("term", F.substring_index(F.substring("_run", 2, 2**31 - 1), " ", 1))
    return named.select(key, "term", F.expr("length(_run) div (length(term) + 1)").alias("tf"))


def posting_frequency(posts: DataFrame) -> DataFrame:
    """(term, df) of postings that are at hand."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bag_of_words(df: DataFrame, key: str, text: str, vocab_size: int | None = None, min_df: int = 1) -> DataFrame:
    """Term counts over all terms, or over the ``vocab_size`` most common ones."""
    posts = postings(df, key, text)
    if vocab_size is None and min_df <= 1:
        return posts
    posts = cut_lineage(posts)  # counted, then cut down
    frequency = posting_frequency(posts)
    kept = vocabulary(frequency, vocab_size, min_df) if vocab_size is not None else frequency.where(F.col("df") >= min_df)
    chosen = cut_lineage(kept.select("term"))
    if small_enough(chosen, ["term"]):
        return posts.join(F.broadcast(chosen), "term", "left_semi")
    return skew_join(posts, chosen, ["term"], "left_semi", [key])


def tf_idf(posts: DataFrame, frequency: DataFrame, rows: Column | int) -> DataFrame:
    """Adds ``weight`` = tf * ln((rows + 1) / (df + 1))."""
    total = rows if isinstance(rows, Column) else F.lit(rows)
    idf = F.log((total + 1) / (F.col("df") + 1))
    summary = frequency.select("term", F.col("df").alias("n"), idf.alias("_idf"))
    joined = summary_join(posts, summary, ["term"], _spread(posts))
    return joined.withColumn("weight", F.col("tf") * F.col("_idf")).drop("_idf")


def scale_stats(cells: DataFrame, rows: Column | int, value: str = "tf") -> DataFrame:
    """(term, mu, sd, z_of_zero, n) over all rows, absent cells counting 0.

    sd is the population deviation, 1 for a constant feature. It is put together
    from the stored cells' own variance and their mean, so that large values
    next to each other keep their digits.
    """
    total = rows if isinstance(rows, Column) else F.lit(rows)
    x = F.col(value).cast("double")
    sums = cells.groupBy("term").agg(
        F.sum(x).alias("s"), F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.count(F.lit(1)).alias("n")
    )
    mu = F.col("s") / total
    absent = F.col("m") * F.col("m") * F.col("n") * (total - F.col("n")) / total
    spread = F.sqrt((F.col("n") * F.col("v") + absent) / total)
    sd = F.when(spread <= 1e-12 * F.abs(mu), F.lit(1.0)).otherwise(spread)
    return sums.select("term", mu.alias("mu"), sd.alias("sd"), "n").withColumn(
        "z_of_zero", -F.col("mu") / F.col("sd")
    )


def scale(cells: DataFrame, rows: Column | int, value: str = "tf") -> DataFrame:
    """Z-score of every stored cell; absent cells have their term's z_of_zero."""
    stats = scale_stats(cells, rows, value)
    joined = summary_join(cells, stats.select("term", "n", "mu", "sd"), ["term"], _spread(cells))
    z = (F.col(value) - F.col("mu")) / F.col("sd")
    return joined.withColumn("z", z).drop("mu", "sd")


def select_features(
    df: DataFrame, chosen: Sequence[int] | DataFrame, features: str = "features", weights: DataFrame | None = None
) -> DataFrame:
    """Keep the chosen columns of a vector, or the chosen terms of long rows.

    ``weights`` (term, n) are the rows of each term where they are known.
    """
    if isinstance(chosen, DataFrame):
        terms_ = cut_lineage(chosen.select("term").distinct())
        if small_enough(terms_, ["term"]):
            return df.join(F.broadcast(terms_), "term", "left_semi")
        return skew_join(df, terms_, ["term"], "left_semi", _spread(df), weights)
    slicer = VectorSlicer(inputCol=features, outputCol="_sliced", indices=list(chosen))
    return slicer.transform(df).drop(features).withColumnRenamed("_sliced", features)


def vectorize(
    df: DataFrame, text: str, vocab_size: int = ALL_TERMS, min_df: float = 1.0, weighting: str = "tfidf"
) -> tuple[DataFrame, PipelineModel]:
    """Sparse term vectors in ``features`` and the fitted model.

    All terms count unless ``vocab_size`` says otherwise; the vocabulary is kept
    in the model, on the driver. Texts are never shuffled.
    """
    with_terms = df.withColumn("_terms", terms(F.col(text)))
    counted = "features" if weighting == "bow" else "_counts"
    stages = [CountVectorizer(inputCol="_terms", outputCol=counted, vocabSize=vocab_size, minDF=min_df).fit(with_terms)]
    if weighting == "tfidf":
        stages.append(IDF(inputCol="_counts", outputCol="features").fit(stages[0].transform(with_terms)))
    model = PipelineModel(stages)
    return model.transform(with_terms).drop("_terms", "_counts"), model


def _spread(cells: DataFrame) -> list[str]:
    """Columns that set rows of the same term apart."""
    return [c for c in cells.columns if c.endswith("_id")] or [c for c in cells.columns if c != "term"]
