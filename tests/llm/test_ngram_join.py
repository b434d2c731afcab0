"""Components against all pairs, on copies edited more and more."""

import random

import pytest

from defectlab.llm import ngram_join
from defectlab.llm.ngram_join import link_components


def expected(rows, n, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    rows, key = [], 0
    for size in (5, 40, 120):
        base = [draw.choice(words) for _ in range(size)]
        for edits in [0] * 5 + [1] * 40 + [2] * 10 + [4] * 10:
            copy = list(base)
            for _ in range(edits):
                copy[draw.randrange(size)] = draw.choice(words)
            rows.append((key, " ".join(copy)))
            key += 1
    for _ in range(40):
        rows.append((key, passage + " " + " ".join(draw.choice(words) for _ in range(draw.randrange(1, 30)))))
        key += 1
    rows += [(key + i, t) for i, t in enumerate(["", None, "one", "One", "one two", "  one\ttwo\n"])]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent", "cold"), [(3, 90, 16), (3, 90, 2), (5, 80, 4), (2, 50, 3)])
def test_same_as_all_pairs(spark, monkeypatch, n, percent, cold):
    monkeypatch.setattr(ngram_join, "COLD", cold)
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = link_components(df, n=n, percent=percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == expected(rows, n, percent)


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = link_components(odd_docs, n=3, percent=90).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == expected(rows, 3, 90)


def test_empty_table(no_docs):
    assert link_components(no_docs, n=3, percent=90).collect() == []


def test_chain_of_links(spark):
    """A component is as wide as its chain, whatever the order of its nodes."""
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    random.Random(1).shuffle(edges)
    found = ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["component"] for r in found if r["node"] <= 200} == {0} and len(found) == 203


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (2, 50)])
def test_every_link(spark, n, percent):
    """No link is lost inside a component: counts of every row against all pairs."""
    rows = [*corpus(n), (None, "one two"), (7, "one two")]
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set()))
    want = []
    for a, (key, _) in enumerate(rows):
        common = [(len(sets[a] & s), len(s)) for b, s in enumerate(sets) if b != a]
        want.append((key, sum(both > 0 and 100 * both >= percent * (len(sets[a]) + size - both) for both, size in common)))
    pairs, members = ngram_join.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n=n, percent=percent)
    found = [tuple(r) for r in ngram_join.link_counts(pairs, members).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert sum(n_links for _, n_links in want) > 2 * pairs.count() > 1_000
