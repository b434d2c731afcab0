"""Base spans against the patterns as written, segmentations against all of them, spans side by side."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from defectlab.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            fails = [False, any(int(p) > 255 for p in m.group().split(".") if kind == 1), not (13 <= len(d) <= 19 and luhn), not 9 <= len(d) <= 15]
            if not fails[kind]:
                found.append((kind, *m.span()))
    return found


def test_base_spans(docs):
    draw = random.Random(1)
    texts = [r["text"] for r in docs.select("text").collect()]
    texts += ["".join(draw.choices("a@.1+ -()9%25_b\n", k=draw.randrange(40))) for _ in range(8000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t)


def test_long_words_cost_little():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "(" * 100_000):
        pii.all_spans(pii.PRIOR, t)


def test_decoding_is_the_best_segmentation():
    draw = random.Random(2)
    weights = np.zeros_like(pii.PRIOR)
    weights[:, 0] = 1.0
    for _ in range(100):
        n = draw.randrange(1, 7)
        spans = [(i, j, draw.randrange(4), [draw.uniform(-1, 2)] + [0.0] * 6) for i in range(n) for j in range(i + 1, n + 1) if draw.random() < 0.5]

        def best(at, n=n, spans=spans):
            return 0.0 if at >= n else max([best(at + 1)] + [f[0] + best(j) for i, j, _, f in spans if i == at])

        chosen = pii.decode(weights, n, spans)
        score = sum(max(f[0] for i, j, k, f in spans if (i, j, k) == c) for c in chosen)
        assert abs(score - best(0)) < 1e-9


def test_side_by_side():
    text = "x +1 (826) 555-4081 4111111111111111 190.137.223.204 4012888888881881 5500005555555559 y"
    _, every = pii.all_spans(pii.PRIOR, text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in every] == [
        ("ip", "190.137.223.204"), ("card", "4111111111111111"), ("card", "4012888888881881"), ("card", "5500005555555559"), ("phone", "+1 (826) 555-4081"),
    ]
    assert pii.redacted(pii.PRIOR, text) == "x [PHONE] [CARD] [IP] [CARD] [CARD] y"


def test_leaves_other_numbers_alone():
    for text in ("order 4111111111111112 shipped", "ISBN 978-3-16-148410-0", "2020-01-01 12:30", "version 2.0.1", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'):
        assert pii.all_spans(pii.PRIOR, text) == ([], [])


def test_columns(docs, odd_docs, no_docs):
    weights = pii.fit_spans(docs)
    rows = docs.select("text", pii.spans(F.col("text"), weights).alias("p")).collect()
    for r in rows:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain(r["text"]))
        assert r["p"]["base"] == base and set(filter(None, base.split(","))) <= set(r["p"]["spans"].split(","))
    assert sum(r["p"]["n_email"] + r["p"]["n_ip"] for r in rows) > 0
    odd = odd_docs.select("text", pii.redact(F.col("text"), pii.fit_spans(odd_docs)).alias("r")).collect()
    assert [r["r"] for r in odd] == [r["text"] for r in odd]
    assert no_docs.select(pii.redact(F.col("text"), pii.fit_spans(no_docs)).alias("r")).collect() == []


def test_sample_of_regions(spark, monkeypatch):
    """Copies count once, whole texts are read, and one text full of numbers leaves room for every other kind."""
    monkeypatch.setattr(pii, "SAMPLE_REGIONS", 20)
    rest = [f"{'word ' * 6_000}from 10.100.{i}.107 or a{i}@b.example" for i in range(5)]
    numbers = " and ".join(f"no {n * 7_654_321 + 12_345_678}" for n in range(300))
    texts = ["one and the same 192.168.7.7 here"] * 3_000 + rest + [numbers]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [sorted(map(tuple, pii.sample_regions(df.repartition(n)).collect())) for n in (1, 7)]
    assert found[0] == found[1]
    kinds = {k: {r["around"][r["start"] : r["end"]] for r in pii.sample_regions(df).filter(F.col("kind") == k).collect()} for k in (0, 1)}
    assert kinds == {0: {f"a{i}@b.example" for i in range(5)}, 1: {f"10.100.{i}.107" for i in range(5)} | {"192.168.7.7"}}
    assert pii.sample_regions(df).filter("kind = -1").count() == 20
