"""Benchmark decontamination: rare n-gram seeds meet passages of the texts, Smith-Waterman scores the meeting.

Words are lower-cased runs without ASCII punctuation. A first pass over all
texts counts in how many of them each ``N``-gram of an item occurs. The rarest
``SEED_SHARE`` of an item's n-grams are its seeds, at least ``LEAST_SEEDS``:
rarity is by rank within the item, so an item that leaked into thousands of
texts still has seeds. A second pass aligns an item with every passage that
holds two of its seeds (one, where the item has fewer than three); two
neighbouring seeds lie within the item's length. The score is that of the best
local alignment (match 2, mismatch and gap -1) divided by that of an exact
copy; from ``MIN_SCORE`` on the text counts as contaminated.

The benchmark is the query set. It is taken in blocks of bounded size, each one
sent to all executors, so texts are never shuffled and a benchmark of any size
works. NULL and empty texts or items match nothing, items of fewer than ``N``
words are one n-gram, repeated rows give equal results, ties between alignments
go to the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.llm.common import text_udf, to_batch

N = 3
SEED_SHARE = 0.7
LEAST_SEEDS = 8
MIN_SCORE = 0.5
BLOCK_CHARS = 4 << 20
BATCH_CHARS = 1 << 19
KIND = "struct<items:array<long>,scores:array<double>,starts:array<int>,ends:array<int>,seeds:array<int>>"

_BLANKED = bytes(0x20 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split()


class Index:
    """A block of items: their words as numbers, and their n-grams as sorted keys."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if words:
                self.ids.append(item)
                self.words.append(np.array(words, dtype=np.int64))
        self.base = len(self.vocabulary) + 1
        found = [(k, i, p) for i, w in enumerate(self.words) for p, k in enumerate(self.grams(w).tolist())]
        found.sort()
        self.keys = np.array([k for k, _, _ in found], dtype=np.int64)
        self.item = np.array([i for _, i, _ in found], dtype=np.int64)
        self.place = np.array([p for _, _, p in found], dtype=np.int64)
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.need = np.zeros(len(self.words), dtype=np.int64)

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Keys of all n-grams; a shorter sequence is one, told apart by its missing words."""
        if not len(words):
            return np.zeros(0, dtype=np.int64)
        padded = np.concatenate([words, np.zeros(max(0, N - len(words)), dtype=np.int64)])
        key = np.zeros(len(padded) - N + 1, dtype=np.int64)
        for k in range(N):
            key = key * self.base + padded[k : len(padded) - N + 1 + k]
        return key

    def keep_rare(self, counts: dict[int, int]) -> None:
        """Keep each item's rarest n-grams; of equally rare ones the first."""
        keep = np.zeros(len(self.keys), dtype=bool)
        df = np.array([counts.get(k, 0) for k in self.keys.tolist()], dtype=np.int64)
        by_item = np.lexsort((self.place, df, self.item))
        edges = np.searchsorted(self.item[by_item], np.arange(len(self.words) + 1))
        for i in range(len(self.words)):
            own = by_item[edges[i] : edges[i + 1]]
            n = max(min(LEAST_SEEDS, len(own)), int(np.ceil(SEED_SHARE * len(own))))
            keep[own[:n]] = True
            self.need[i] = 1 if n < 3 else 2
        self.keys, self.item, self.place = self.keys[keep], self.item[keep], self.place[keep]

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of many texts, 0 for words of no item, and where each text starts; ``N`` zeros part them."""
        split = [words_of(t) for t in texts]
        gap = [b""] * N
        flat = [w for own in split for w in (*own, *gap)]
        known = np.fromiter(map(self.vocabulary.get, flat, repeat(0)), dtype=np.int64, count=len(flat))
        return known, np.cumsum([0] + [len(own) + N for own in split])

    def meetings(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among ``known`` where an n-gram of an item starts, and its key."""
        short = min(self.sizes, default=N) < N
        if len(known) < N or not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        inside = known[: len(known) - N + 1] > 0
        for k in range(1, N):
            inside &= known[k : len(known) - N + 1 + k] > 0
        at = np.flatnonzero(inside)
        key = np.zeros(len(at), dtype=np.int64)
        for k in range(N):
            key = key * self.base + known[at + k]
        if short:  # items of fewer words: their key has zeros at its end
            for size in range(1, N):
                m = np.flatnonzero(known[: len(known) - N + 1] > 0)
                for k in range(1, size):
                    m = m[known[m + k] > 0]
                part = np.zeros(len(m), dtype=np.int64)
                for k in range(N):
                    part = part * self.base + (known[m + k] if k < size else 0)
                at, key = np.concatenate([at, m]), np.concatenate([key, part])
        hit = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], key[hit][order]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: best score and the passage's first and last-but-one word."""
    n = len(passage)
    steps = np.arange(1, n + 1)
    above, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, 2, -1)
        gap = above[1:] - 1
        now = np.maximum(np.maximum(diagonal, gap), 0)
        start = np.where(now == 0, steps, np.where(diagonal >= gap, begin[:-1], begin[1:]))
        # A gap along the row costs one a word: the best of now[j] + j to the left, less the place.
        lifted = now + steps
        reach = np.maximum.accumulate(lifted)
        row = np.maximum(reach - steps, 0)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(n), 0))
        above = np.concatenate([[0], row])
        begin = np.concatenate([[0], np.where(row > 0, start[source], steps)])
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(begin[j + 1]), j + 1)
    return best


def _batches(texts: list):
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t or "") > BATCH_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t or "") + 1
    if start < len(texts):
        yield start, len(texts)


def _document_counts(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each n-gram occurs: at most a row for each n-gram of the block."""
    index: Index = shared.value
    keys = np.unique(index.keys)
    counts = np.zeros(len(keys), dtype=np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for low, high in _batches(texts):
            known, starts = index.numbers(texts[low:high])
            at, key = index.meetings(known)
            if len(at):
                doc = np.searchsorted(starts, at, "right") - 1
                pairs = np.unique(doc * len(keys) + np.searchsorted(keys, key))
                counts += np.bincount(pairs % len(keys), minlength=len(keys))
    seen = np.flatnonzero(counts)
    yield to_batch([keys[seen], counts[seen]], "gram long,n long")


def _hits_of(index: Index, words: np.ndarray, at: np.ndarray, key: np.ndarray, min_score: float) -> list[tuple]:
    """``(item number, score, start, end, seeds)`` of every item one text holds, by item."""
    low, high = np.searchsorted(index.keys, key, "left"), np.searchsorted(index.keys, key, "right")
    n = high - low
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    place, item = np.repeat(at, n), index.item[entry]
    order = np.lexsort((place, item))
    place, item, of_item = place[order], item[order], index.place[entry][order]
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (np.diff(place) > index.sizes[item[1:]])
    starts = np.append(np.flatnonzero(new), len(item))
    best: dict[int, tuple] = {}
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        i = int(item[a])
        seeds = len(set(of_item[a:b].tolist()))
        if seeds < index.need[i]:
            continue
        size = int(index.sizes[i])
        first, last = max(0, int(place[a]) - size), min(len(words), int(place[b - 1]) + size + N)
        score, begin, end = align(index.words[i], words[first:last])
        share = score / (2 * size)
        if share >= min_score and (i not in best or share > best[i][1]):
            best[i] = (i, share, first + begin, first + end, seeds)
    return [best[i] for i in sorted(best)]


def _finder(shared, min_score):
    index: Index = shared.value

    def work(texts):
        found = []
        for low, high in _batches(texts):
            known, starts = index.numbers(texts[low:high])
            at, key = index.meetings(known)
            edges = np.searchsorted(at, starts)
            for d in range(high - low):
                a, b = edges[d], edges[d + 1]
                words = known[starts[d] : starts[d + 1] - N]
                hits = _hits_of(index, words, at[a:b] - starts[d], key[a:b], min_score) if b > a else []
                found.append(([index.ids[h[0]] for h in hits], *([h[k] for h in hits] for k in range(1, 5))))
        return found

    return work


def indexes(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> list:
    """Broadcast indexes of the benchmark's blocks with their seeds chosen; at least one, maybe empty."""
    context = docs.sparkSession.sparkContext
    blocks, held = [[]], 0
    for row in benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        if blocks[-1] and held + len(row["t"] or "") > BLOCK_CHARS:
            blocks.append([])
            held = 0
        blocks[-1].append((row["i"], row["t"]))
        held += len(row["t"] or "")
    made = []
    for block in blocks:
        index = Index(sorted(block, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
        shared = context.broadcast(index)
        counted = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(partial(_document_counts, shared), "gram long, n long")
        counts = {r["gram"]: r["n"] for r in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # at most the block's n-grams
        index.keep_rare(counts)
        made.append(context.broadcast(index))
    return made


def hits(text: Column, index, min_score: float = MIN_SCORE) -> Column:
    """Items of one block found in a text: parallel arrays of item, score, first and last-but-one word, and seeds."""
    return text_udf(KIND, partial(_finder, index, min_score))(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """One row for every document and item it holds: ``doc_id``, ``item_id``, ``score``, ``start``, ``end``, ``seeds``."""
    found = []
    for index in indexes(docs, benchmark, text):
        rows = docs.select(F.col(key).alias("doc_id"), hits(F.col(text), index, min_score).alias("h")).filter(F.size("h.items") > 0)
        each = F.arrays_zip(*[F.col(f"h.{c}").alias(c) for c in ("items", "scores", "starts", "ends", "seeds")])
        found.append(
            rows.select("doc_id", F.explode(each).alias("h")).select(
                "doc_id", F.col("h.items").alias("item_id"), F.col("h.scores").alias("score"), F.col("h.starts").alias("start"),
                F.col("h.ends").alias("end"), F.col("h.seeds").alias("seeds"),
            )
        )
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents that hold no item of the benchmark, all columns as they were."""
    for index in indexes(docs, benchmark, text):
        docs = docs.filter(F.size(hits(F.col(text), index, min_score)["items"]) == 0)
    return docs
