"""Planted copies, edited copies and clean texts; alignment against a plain table."""

import random

import numpy as np
import pytest

from defectlab.llm import decontaminate as d


def plain_best(item, passage):
    above, best = [0] * (len(passage) + 1), 0
    for w in item:
        row = [0]
        for j, p in enumerate(passage):
            row.append(max(0, above[j] + (2 if w == p else -1), above[j + 1] - 1, row[j] - 1))
        above, best = row, max(best, *row)
    return best


def test_alignment():
    draw = random.Random(1)
    for _ in range(300):
        item = np.array([draw.randrange(1, 6) for _ in range(draw.randrange(1, 12))])
        passage = np.array([draw.randrange(6) for _ in range(draw.randrange(1, 20))])
        score, start, end = d.align(item, passage)
        assert score == plain_best(item.tolist(), passage.tolist())
        if score:
            assert plain_best(item.tolist(), passage[start:end].tolist()) == score


@pytest.fixture(scope="module")
def planted():
    draw = random.Random(2)
    words = ["the", "of", "and", "in"] * 20 + [f"word{i}" for i in range(500)]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(draw.randrange(15, 50)))) for i in range(30)]
    rows, leaks = [], set()
    for key in range(200):
        body = text(draw.randrange(5, 300))
        if key % 4 == 0:
            item, copy = items[key % 30][0], items[key % 30][1].split()
            for _ in range(len(copy) // 8 if key % 8 else 0):
                at = draw.randrange(len(copy))
                copy[at : at + 1] = draw.choice([[], ["changed"], [copy[at], "added"]])
            body[len(body) // 2 : len(body) // 2] = copy
            leaks.add((key, item))
        rows.append((key, " ".join(body)))
    return items, rows, leaks


def test_copies_and_edits(spark, planted, monkeypatch):
    items, rows, leaks = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench).collect()} == leaks
    assert {r["doc_id"] for r in d.clean(docs, bench).collect()} == {k for k, _ in rows} - {k for k, _ in leaks}
    monkeypatch.setattr(d, "BLOCK_CHARS", 300)  # many blocks
    assert {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench).collect()} == leaks


def test_an_item_in_every_text(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"start {i} {item} end") for i in range(100)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, "two words"), (4, None), (5, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench).collect()}
    assert found == {(i, b) for i in range(100) for b in (1, 2)}


def test_short_items_and_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "same text"), (2, "text"), (None, "no id at all")], "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in d.contaminated(odd_docs, bench).collect()), key=repr)
    assert found == sorted([(4, 1), (4, 1), (5, 1), (4, 2), (4, 2), (5, 2), (9, 2), (None, None)], key=repr)
    assert d.contaminated(no_docs, bench).collect() == []
    assert d.clean(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert d.clean(odd_docs, bench).columns == odd_docs.columns
