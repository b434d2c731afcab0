"""The search against scoring every document for every item; bounds, ties, blocks, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from defectlab.llm import search

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    held = [(d, words(t)) for d, t in docs]
    held = [(d, Counter(w), len(w)) for d, w in held if w]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(words(text))
    found = []
    for item, terms in wanted.items():
        scored = []
        for doc, counts, n in held:
            m = 100 - 50 + 50 * n * total // length
            score = 0
            for t in terms & counts.keys():
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        found += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(scored)[:top])]
    return sorted(found, key=repr)


def searched(docs, items, **settings):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search(docs, items, **settings).collect()), key=repr)


def corpus(seed, n=400, vocabulary=60):
    rng = random.Random(seed)
    terms = [f"t{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    texts = [" ".join(rng.choices(terms, weights, k=rng.randrange(1, 40))) for _ in range(n // 2)]
    return [(i, rng.choice(texts)) for i in range(n)], [(i, " ".join(rng.choices(terms, weights, k=8))) for i in range(12)]


@pytest.mark.parametrize(("seed", "top"), [(1, 5), (2, 50), (3, 1)])
def test_equals_scoring_everything(spark, seed, top):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items, top)
    assert searched(d, i, top=top) == want
    assert searched(d, i, top=top, block_bytes=100) == want  # items in several blocks


def test_whole_tables(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 50)
    assert searched(docs, items) == want


def _tree(docs, items):
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, text in items for t in words(text)}))}
    totals = Counter(vocabulary[t] for _, c, _ in held for t in c if t in vocabulary)
    totals.update({-1: len(held), -2: sum(n for _, _, n in held)})
    terms = search.Terms(len(vocabulary), totals)
    own = [{vocabulary[t]: n for t, n in c.items() if t in vocabulary} for _, c, _ in held]
    arrays = [[np.array(list(side), dtype="<i4") for side in (c, c.values())] for c in own]
    tree = search.Tree(terms, [d for d, _, _ in held], np.array([n for _, _, n in held]), [a for a, _ in arrays], [b for _, b in arrays])
    return terms, tree, search.grouped(terms, [sorted({vocabulary[t] for t in words(text)}) for _, text in items])


def test_nodes_bound_all_documents_below(monkeypatch):
    monkeypatch.setattr(search, "LEAF_DOCS", 4)
    docs, items = corpus(7)
    terms, tree, (group,) = _tree(docs, items)
    best = search.Best(terms, group, 5)
    every = np.ones(len(group), dtype=bool)

    def scores(low, high):
        parts = np.zeros((high - low, len(terms.weight)), dtype=np.int64)
        for row in range(low, high):
            at = slice(tree.start[row], tree.start[row + 1])
            counts = np.zeros(len(terms.weight), dtype=np.int64)
            counts[tree.terms[at]] = tree.counts[at]
            parts[row - low] = terms.parts(counts, tree.m[row])
        return group.sums(parts, every)

    leaves = []
    for node, (low, high) in enumerate(tree.span):
        assert (best.bounds(tree, [node])[0] >= scores(low, high).max(axis=0)).all()
        if tree.below[node]:
            spans = [tree.span[c] for c in tree.below[node]]
            assert spans[0][0] == low and spans[-1][1] == high and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        else:
            leaves.append((low, high))
    assert sum(b - a for a, b in leaves) == len(docs)


def test_bounds_save_work(monkeypatch):
    monkeypatch.setattr(search, "LEAF_DOCS", 4)
    docs, items = corpus(11, n=2000)
    terms, tree, (group,) = _tree(docs, items)
    best = search.Best(terms, group, 3)
    best.search(tree)
    assert 0 < best.scored < len(docs) * len(items)


@pytest.mark.parametrize(("cells", "counts", "terms"), [(64, 50, 3), (1 << 20, 1 << 20, 1)])
def test_small_trees_and_groups_give_the_same(monkeypatch, cells, counts, terms):
    docs, items = corpus(5)
    whole, tree, groups = _tree(docs, items)
    want = {(item, d, s) for item, _, d, s in plain(docs, items, 4)}
    monkeypatch.setattr(search, "GROUP_TERMS", terms)
    _, _, groups = _tree(docs, items)
    assert len(groups) > 1
    found = set()
    for group in groups:
        best = search.Best(whole, group, 4)
        best.search(tree)
        found |= set(best.rows())
    assert found == want


def test_ties_and_copies_by_id(spark):
    docs = [(i, "same words here") for i in (9, 3, 7, 1, 5)] + [(None, "same words here"), (3, "same words here"), (2, "other")]
    items = [(1, "words"), (1, "HERE"), (None, "same"), (2, None), (3, "?!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert searched(d, i, top=4) == plain(docs, items, 4)
    assert [r[2] for r in sorted((r for r in searched(d, i, top=4) if r[0] == 1), key=lambda r: r[1])] == [None, 1, 3, 3]


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "same text"), (2, "w1x1 w2x2 cödé"), (3, "x" * 50_000), (4, "")]
    i = spark.createDataFrame([(*r, "clash", "clash") for r in items], "item_id long, text string, doc_id string, score string")
    assert searched(odd_docs, i) == plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()], items, 50)
    assert searched(no_docs, i) == [] and searched(odd_docs, i.limit(0)) == []
    assert search.search(no_docs, i).dtypes == search.search(odd_docs, i.limit(0)).dtypes == search.search(odd_docs, i).dtypes
