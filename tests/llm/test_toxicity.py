"""The channel on disguised words, held-out accuracy, labels that may not be read."""

import zlib

import pytest
from pyspark.sql import functions as F

from defectlab.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def characters(tables):
    return toxicity.character_model(tables[0])


@pytest.fixture(scope="module")
def model(tables, characters):
    return toxicity.fit_labels(*tables, characters)


def test_counts_cover_all_texts(tables):
    text = "  ".join(["", *(r["text"] for r in tables[0].select("text").collect()), ""])
    rows = list(toxicity._count_trigrams([tables[0].select("text").toArrow().to_batches()[0]]))[0]
    assert sum(rows.column(1).to_pylist()) <= len(text)


def test_restores_disguised_words(characters):
    reader = toxicity.Reader(characters)
    for token, word in (("1d10t", "idiot"), ("stuuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("cl0wn", "clown"), ("M0R0N!!", "moron"), ("tr4sh", "trash"), ("s-t-u-p-i-d", "stupid")):
        assert reader.text(token) == [word]
    assert reader.text("such an i d i o t here") == ["such", "an", "idiot", "here"]
    assert reader.text("plain Words, stay. 2.0 2024") == ["plain", "words", "stay"]


def test_held_out_accuracy(tables, characters, model):
    docs, labels = tables
    rows = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("toxic", toxicity.score(F.col("text"), characters, model).alias("s")).collect()
    good, bad = [r["s"] for r in rows if r["toxic"]], [r["s"] for r in rows if not r["toxic"]]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.85
    assert sum(b >= 0.7 for b in bad) <= 0.02 * len(bad)


def test_held_out_labels_are_not_read(tables, characters, model):
    docs, labels = tables
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_labels(docs, changed, characters) == model


def test_held_out_column(spark):
    rows = spark.range(300).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_disguise_does_not_help(spark, characters, model, tables):
    words = sorted(model[0], key=lambda f: -model[0][f])
    assert words
    plain = "the idiot and the moron are stupid"
    hidden = "the 1d10t and the m0r0n are s.t.u.p.i.d"
    df = spark.createDataFrame([(plain,), (hidden,)], "text string")
    a, b = (r["s"] for r in df.select(toxicity.score(F.col("text"), characters, model).alias("s")).collect())
    assert abs(a - b) < 1e-9 and a > 0.7


def test_odd_rows(spark, odd_docs, no_docs, tables):
    characters = toxicity.character_model(odd_docs)
    for labels in (tables[1], tables[1].limit(0), spark.createDataFrame([(None, 1), (4, None)], "doc_id long, toxic int")):
        model = toxicity.fit_labels(odd_docs, labels, characters)
        scores = [r["s"] for r in odd_docs.select(toxicity.score(F.col("text"), characters, model).alias("s")).collect()]
        assert len(scores) == odd_docs.count() and all(0 <= s <= 1 for s in scores)
    empty = toxicity.character_model(no_docs)
    assert no_docs.select(toxicity.score(F.col("text"), empty, ({}, 0.0)).alias("s")).collect() == []
