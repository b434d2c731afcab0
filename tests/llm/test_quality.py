"""Base counts against plain code, Viterbi against all paths, accuracy on labels not in the sample."""

import itertools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from defectlab.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    words = re.findall(WORD, text or "")
    lines = [line for line in (text or "").split("\n") if re.search(WORD, line)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    again = sum(line in lines[:i] for i, line in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered))


def odd_texts():
    draw = random.Random(1)
    letters = ["a", "b", " ", "\n", "\t", "|", "#", "é", "🙂", "\x85", "\x1c", "\r", "A", "!", "."]
    return [None, "", " ", "\n\n", "a b c a b c", "\na\n\na\n"] + ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(400)]


def test_base_counts(docs):
    texts = odd_texts() + [r["text"] for r in docs.select("text").collect()]
    model = (quality.PRIOR, np.zeros((2, 2)))
    for size in (1 << 6, 1 << 19):
        quality.BATCH_CHARS, old = size, quality.BATCH_CHARS
        found = quality.judge(model, 0.5, texts)
        quality.BATCH_CHARS = old
        for text, got in zip(texts, found, strict=True):
            want = plain(text)
            assert got[:5] == want
            assert got[5] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (got[5] and got[7])


def test_viterbi_is_the_best_path():
    draw = random.Random(2)
    for n in range(1, 9):
        scores = [draw.uniform(-2, 2) for _ in range(n)]
        moves = np.array([[draw.uniform(-1, 1) for _ in range(2)] for _ in range(2)])

        def value(path, scores=scores, moves=moves):
            return sum(s for s, p in zip(scores, path, strict=True) if p) + sum(moves[a, b] for a, b in itertools.pairwise(path))

        assert value(quality.viterbi(scores, moves)) == max(map(value, itertools.product((0, 1), repeat=n)))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen = labels.filter("doc_id % 2 = 0")
    found = docs.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", quality.verdict(F.col("text"), quality.fit_lines(docs, seen)).alias("v"))
    rows = found.filter("NOT v.base_failed").collect()
    assert len(rows) > 100
    assert sum(r["v"]["kept"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        model = quality.fit_lines(odd_docs, given)
        rows = odd_docs.select("text", quality.verdict(F.col("text"), model).alias("v")).collect()
        assert [tuple(r["v"])[:5] for r in rows] == [plain(r["text"]) for r in rows]
        assert no_docs.select(quality.verdict(F.col("text"), model).alias("v")).collect() == []
