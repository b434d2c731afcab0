"""The audit against plain counting, the tree against all pairs of cells, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from defectlab.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, min_docs, ranks):
    """The contract word by word, over all pairs of sources and all kept terms."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", WORD.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    found = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                found |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(items)}
    return found


def audited(df, **settings):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df, **settings).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed):
    rng = random.Random(seed)
    words = ["the", "THE", "Éa", "éa", "a1b", "x", "über", "Zebra", "日本", *(f"w{c}" for c in "abcdefghij")]
    rows = [(rng.choice(["en", "de"]), f"s{min(rng.randrange(9), 6)}", " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(120)]
    rows += [("fr", "alone", "un deux"), ("es", "a", "uno"), ("es", "b", None), (None, "s1", "the x"), (None, None, "")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    for min_docs, ranks in ((3, 4), (1, 50), (60, 2)):
        assert audited(df, min_docs=min_docs, term_ranks=ranks) == plain(rows, min_docs, ranks)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    assert audited(docs) == plain(rows, 30, 50)


def _paths(rng, n_sources, n_rows):
    for _ in range(n_rows):
        own = sorted(rng.sample(range(n_sources), rng.randrange(1, n_sources)))
        yield tuple((s, rng.choice([1, 1, 1, 2, 7])) for s in own)


@pytest.mark.parametrize("most", [1 << 20, 8])
def test_tree_equals_all_pairs_of_cells(monkeypatch, most):
    monkeypatch.setattr(divergence, "MOST_CORRECTIONS", most)
    rng = random.Random(5)
    z = {s: 10 * s + 3 for s in range(7)}
    p = {(s, n): z[s] + 17 * n + s for s in range(7) for n in (1, 2, 7)}
    rows = sorted((lang, path, m) for lang in ("a", "b") for path, m in Counter(_paths(rng, 7, 300)).items())
    want = Counter()
    for lang, path, m in rows:
        for i, (a, n) in enumerate(path):
            for b, k in path[:i]:
                want[lang, f"s{a}", f"s{b}"] += m * (abs(p[a, n] - p[b, k]) - abs(p[a, n] - z[b]) - abs(z[a] - p[b, k]) + abs(z[a] - z[b]))
    cells = [[{"source": f"s{s}", "n": n, "p": p[s, n], "z": z[s]} for s, n in path] for _, path, _ in rows]
    table = pa.record_batch({"lang": [r[0] for r in rows], "path": cells, "m": [r[2] for r in rows]})
    got, emitted = Counter(), 0
    for part in (table, ), (table.slice(0, 111), table.slice(111)):
        got.clear()
        for batch in divergence._corrections(iter(part)):
            emitted += batch.num_rows
            for r in batch.to_pylist():
                got[r["lang"], r["a"], r["b"]] += r["v"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_shared_paths_are_closed_once():
    path = divergence._OpenPath()
    cell = np.array([1, 2, 3], dtype=np.int64)
    path.enter(cell, cell, cell * 10, cell, 4)
    path.enter(cell[:2], cell[:2], cell[:2] * 10, cell[:2], 5)
    path.close(0)
    assert len(path.found) == 2  # the second and the third node; the path of two ends inside the first row's
    assert path.rows[0] == 9


def test_counts_are_handed_on_when_full(monkeypatch, spark):
    monkeypatch.setattr(divergence, "MOST_COUNTS", 3)
    batch = pa.record_batch({"lang": ["a"] * 4, "source": ["s"] * 4, "text": ["x y z", "x y", "q r x", ""]})
    found = Counter()
    for out in divergence._count_terms(iter([batch])):
        for r in out.to_pylist():
            found[r["term"]] += r["n"]
    assert found == Counter("x y z x y q r x".split())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    assert audited(odd_docs, min_docs=1) == plain(rows, 1, 50)
    assert audited(no_docs) == set()
