"""Laws of the shards, and how many links are cut."""

import zlib
from collections import Counter, defaultdict

import pytest

from defectlab.llm import sharding


def laws(rows, shards=8):
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(shards))
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_documents(docs):
    rows = sharding.shard_documents(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    laws(rows)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_a_third_of_copies(spark):
    texts = ["hot"] * 300 + [f"pair {i // 2}" for i in range(200)] + [f"single {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sharding.shard_documents(df).collect()
    laws(rows)
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert len(where["hot"]) <= 5  # three shards could hold it
    assert sum(len(where[f"pair {i}"]) > 1 for i in range(100)) <= 5


def test_all_linked(spark):
    """No row is free to fill up: rows above a quota give way."""
    df = spark.createDataFrame([(i, f"group {i % 3}") for i in range(100)], "doc_id long, text string")
    laws(sharding.shard_documents(df).collect())


def test_general_links(spark):
    nodes = spark.range(64).withColumnRenamed("id", "node")
    members = spark.createDataFrame([(i, g) for i in range(64) for g in (f"a{i // 8}", f"b{i // 4}")], "node long, group string")
    rows = sharding.shard(nodes, members, shards=8).collect()
    laws(rows)


@pytest.mark.parametrize("bucket", [7, 50_000])
def test_numbers_have_no_gap(spark, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", bucket)
    from pyspark.sql import functions as F

    df = sharding.numbered(spark.range(100).withColumnRenamed("id", "node"), 100, F.col("node") % 3, "node")
    rows = df.collect()
    for p in range(3):
        assert sorted(r["pos"] for r in rows if r["node"] % 3 == p) == list(range(sum(i % 3 == p for i in range(100))))


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    laws(rows)
    assert all((r["size"], r["text_crc32"]) == (1, 0) for r in rows if r["doc_id"] == 6)
    assert sharding.shard_documents(no_docs).collect() == []
