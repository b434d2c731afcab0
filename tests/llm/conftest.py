import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Columns that clash with names the operators use inside or return.
CLASHING = ["n_words", "kept", "shard", "slot", "node", "key", "tokens", "score", "n_tokens", "start", "component_id", "text_crc32", "value"]
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and very long texts, repeated rows and ids, clashing columns."""
    texts = [
        (None, None), (None, "no id at all"), (1, ""), (2, " \n\t "), (3, LONG), (4, "same text twice"), (4, "same text twice"),
        (5, "same text twice"), (6, None), (7, "ünï cödé 🙂 日本語"), (8, "a\x1cb \x85 \x00 c"), (9, "x" * 50_000), (9, "another text under one id"),
    ]
    fields = [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())]
    fields += [StructField(c, StringType()) for c in CLASHING]
    rows = [(i, t, None, None, None, *["clash"] * len(CLASHING)) for i, t in texts]
    return spark.createDataFrame(rows, StructType(fields)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
