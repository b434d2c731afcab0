"""The stages one after the other, and on odd rows."""

import corpus_pipeline
import pytest
import tiktoken  # noqa: F401
from pyspark.sql import functions as F

from defectlab.llm import pii, quality, stages
from defectlab.llm.decontaminate import words_of


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, made[-1], small).write.parquet(str(folder / name))
        made.append(spark.read.parquet(str(folder / name)))
    return made


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_leaks", "personal_data", "byte_bpe"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_follows_the_query(spark, small, steps):
    model = quality.fit_lines(steps[0], spark.read.parquet(f"{small}/labels.parquet"))
    kept = {r["doc_id"] for r in steps[0].filter(quality.verdict(F.col("text"), model)["kept"]).collect()}
    assert {r["doc_id"] for r in steps[1].collect()} == kept and 0 < len(kept) < steps[0].count()


def test_one_of_each_group(steps):
    def sets(df):
        found = {}
        for r in df.collect():
            w = r["text"].encode().lower().split()
            found[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
        return found

    before, after = sets(steps[1]), sets(steps[2])
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    gone = set(before) - set(after)
    assert all(any(near(before[g], s) for i, s in before.items() if i != g) for g in gone)
    left = list(after.items())
    assert not any(near(a, b) for i, (_, a) in enumerate(left) for _, b in left[:i])


def test_no_leak_stays(spark, small, steps):
    items = [b" ".join(words_of(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = [b" ".join(words_of(r["text"])) for r in steps[3].collect()]
    assert not any(i in t for i in items for t in texts)
    gone = {r["doc_id"] for r in steps[2].collect()} - {r["doc_id"] for r in steps[3].collect()}
    assert gone == {r["doc_id"] for r in steps[2].collect() if any(i in b" ".join(words_of(r["text"])) for i in items)}


def test_personal_data_is_gone(steps):
    rows = steps[4].collect()
    assert not any(pii.base_spans(r["text"]) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    untouched = {r["doc_id"]: r["text"] for r in steps[3].collect() if not pii.regions(r["text"])}
    assert untouched and all(r["text"] == untouched[r["doc_id"]] for r in rows if r["doc_id"] in untouched)


def test_last_stage(steps):
    assert all(bytes(r["decoded"]) == r["text"].encode() for r in steps[5].collect())


def test_odd_rows(spark, small, odd_docs, no_docs):
    again = odd_docs.drop("n_tokens").withColumn("ids", F.lit("clash"))
    kept = stages.near_duplicates(spark, again, small)
    assert kept.columns == again.columns
    assert sorted((r["text"] or "" for r in kept.collect())) == sorted(
        ["", "", "", " \n\t ", "no id at all", "same text twice"] + [r["text"] for r in again.collect() if r["doc_id"] in (3, 7, 8, 9)]
    )
    for docs in (again, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, small).count() <= docs.count()
    assert stages.token_ids(spark, again, small).columns.count("ids") == 1
