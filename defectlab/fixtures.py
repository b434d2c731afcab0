"""The shapes the operators work on, derived from the given tables as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlab.functions.text import terms
from defectlab.plans.skew import bounded_rows
from defectlab.sources import read_texts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on row by row."""
    return read_texts(spark, f"{folder}/{name}.parquet")


def patch_of(text: Column) -> Column:
    """A patch whose hunks of six lines hold the text's lines under all kinds of signs."""
    lines = F.filter(F.split(text, "\n"), lambda l: l != "")

    def signed(line: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        head = F.when(
            i % 6 == 0, F.concat(F.lit("@@ -"), number, F.lit(",6 +"), number, F.lit(",6 @@\n"))
        ).otherwise("")
        kind = i % 5
        body = (
            F.when(kind == 0, F.concat(F.lit("-"), line))
            .when(kind == 1, F.concat(F.lit("+"), line, F.lit("\r")))
            .when(kind == 2, F.concat(F.lit("  -"), line))
            .when(kind == 3, F.concat(F.lit(" "), line))
            .otherwise(F.concat(F.lit("!"), line))
        )
        return F.concat(head, body)

    return F.array_join(F.transform(lines, signed), "\n")


def path_of(key: str) -> Column:
    ending = F.element_at(F.array(*map(F.lit, ("yml", "YAML", "py", "j2"))), (F.col(key) % 4 + 1).cast("int"))
    return F.concat(F.lit("roles/r"), (F.col(key) % 7).cast("string"), F.lit("/main."), ending)


def commit_key(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """One patch per document."""
    docs = texts(spark, folder)
    return docs.select("doc_id", "source", "lang", patch_of(F.col("text")).alias("patch"))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """A commit per document: its file, one without a patch, and the first name again."""
    made = F.inline(F.array(F.struct(patch_of(F.col("text")).alias("patch"))))
    docs = texts(spark, folder).select("doc_id", "source", made)
    path = path_of("doc_id")
    files = F.array(
        F.struct(path.alias("filename"), F.col("patch").alias("patch")),
        F.struct(F.lit("README.md").alias("filename"), F.lit(None).cast("string").alias("patch")),
        F.struct(path.alias("filename"), F.lit("@@ -1 +1 @@\n-again").alias("patch")),
    )
    return docs.select(
        F.concat(F.lit("org/"), "source").alias("repository"), commit_key("doc_id").alias("sha"), files.alias("files")
    )


def worklist(spark: SparkSession, folder: str) -> DataFrame:
    """A work-list row per document; some sources and languages are faulty or missing."""
    docs = table(spark, folder, "documents")
    source, lang = F.col("source"), F.col("lang")
    repository = (
        F.when(source == "src7", F.concat(F.lit("org"), source))
        .when(source == "src8", F.concat(F.lit("org/"), source, F.lit("/x")))
        .otherwise(F.concat(F.lit("org/"), source))
    )
    commit = (
        F.when(source == "src9", "")
        .when(lang == "es", F.md5(F.concat(F.lit("x"), F.col("doc_id").cast("string"))))
        .otherwise(commit_key("doc_id"))
    )
    path = F.when(lang == "fr", "roles/r99/main.yml").otherwise(path_of("doc_id"))
    return docs.select(
        F.col("doc_id").alias("wl_id"), repository.alias("repository"), commit.alias("commit_id"), path.alias("filepath")
    )


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled scripts."""
    docs = texts(spark, folder).select(F.col("doc_id").alias("script_id"), F.col("text").alias("content"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("script_id"), F.col("quality").alias("label"))
    return docs.join(labels, "script_id")


def _turn_key() -> Column:
    return F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))


def project_commits(spark: SparkSession, folder: str) -> DataFrame:
    """A project per conversation, a commit per turn, titled by its text."""
    turns = texts(spark, folder, "conversations")
    return turns.select(
        F.col("conv_id").alias("project_id"), _turn_key().alias("commit_id"), F.col("text").alias("title")
    )


def project_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """One diff per commit of those projects."""
    turns = texts(spark, folder, "conversations")
    return turns.select(
        F.col("conv_id").alias("project_id"),
        _turn_key().alias("commit_id"),
        path_of("turn").alias("new_path"),
        patch_of(F.col("text")).alias("diff"),
    )


def project_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The projects as they land, one page per project."""
    turns = table(spark, folder, "conversations")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    return ids.select(
        (F.col("id") + 1).cast("int").alias("page"), F.array(F.struct("id")).alias("projects")
    )


def token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every title token with a tag and the vector its digest points to, stretched by one of five lengths."""
    tokens = project_commits(spark, folder).select(F.explode(terms(F.col("title"))).alias("token")).distinct()
    length = (F.col("vec_id") % 5 + 1).cast("double") / 2
    stretched = F.transform("embedding", lambda x: x.cast("double") * length)
    vectors = table(spark, folder, "embeddings").select("vec_id", stretched.alias("vector"))
    size = vectors.agg(F.max("vec_id") + 1).scalar()
    digit = F.conv(F.substring(F.md5("token"), 8, 1), 16, 10).cast("int")
    tag = F.when(digit < 6, "NOUN").when(digit < 11, "VERB").otherwise("ADJ")
    place = F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("long") % size
    return tokens.select("token", tag.alias("pos"), place.alias("vec_id")).join(vectors, "vec_id").drop("vec_id")


def tagged_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of a title token with a tag of its own: the same word is tagged this way here and that way there."""
    turns = project_commits(spark, folder).select("project_id", "commit_id", F.posexplode(terms(F.col("title"))).alias("place", "token"))
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", "commit_id", F.col("place").cast("string"), "token")), 8, 1), 16, 10).cast("int")
    return turns.withColumn("tag", F.when(digit < 6, "NOUN").when(digit < 11, "VERB").otherwise("ADJ"))


def keyword_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh vector as a keyword."""
    return table(spark, folder, "embeddings").where("vec_id % 7 = 0").select(F.col("embedding").alias("vector"))


def keyword_vectors(spark: SparkSession, folder: str) -> list[list[float]]:
    """The first vector of every class as the keyword list, one per class."""
    firsts = table(spark, folder, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    rows = bounded_rows(firsts, 1024)
    if rows is None:
        raise ValueError("a keyword list has at most 1024 vectors")
    return [list(r["v"]) for r in rows]


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Scores for the labelled documents."""
    labels = table(spark, folder, "labels")
    score = (F.col("doc_id") * 37 % 101) / F.lit(100.0)
    return labels.select(
        F.col("doc_id").alias("example_id"),
        F.col("quality").alias("label"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("prediction"),
        (F.col("doc_id") % 8).cast("int").alias("fold"),
        F.when(F.col("toxic") == 1, "validation").otherwise("test").alias("phase"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """A metric row per event, its type as the model."""
    events = table(spark, folder, "events")
    precision, recall = F.col("user_id") / 150.0, F.col("value") / 500.0
    return events.select(
        F.col("event_type").alias("model"),
        F.col("event_id").alias("run"),
        ((F.col("event_id") * 37 % 1009) / 1009.0).alias("auc"),
        precision.alias("precision"),
        recall.alias("recall"),
        ((precision + recall) / 2).alias("f1"),
    )


def eval_log(spark: SparkSession, folder: str) -> DataFrame:
    """A training log per class of the vectors."""
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("fold"), F.col("vec_id").alias("epoch"), ((F.col("vec_id") * 37 % 101) / 101.0).alias("acc")
    )


def script_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Scripts as maps, one map per row, coded by language."""
    docs = texts(spark, folder)
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    code = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    script = F.struct(F.col("text").alias("content"), F.col("quality").alias("label"), code.alias("dataset_id"))
    return docs.join(labels, "doc_id").select(F.create_map(F.col("doc_id").cast("string"), script).alias("dump"))


def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages of one listing per order, seven pages each."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("listing"), F.col("l_linenumber").alias("page"), F.lit(7).alias("total_pages")
    )
