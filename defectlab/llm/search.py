"""Ranked lexical search: the best documents of every item, by branch and bound over trees of documents.

A document is its term counts restricted to the items' terms. Each task takes its
documents in slices and puts a slice into a frequent-pattern tree: terms stand in
order of their document frequency, the commonest first, and vectors that begin
alike share a path. Chains without a branch are one node, and small siblings one
leaf. A node knows the largest count of each term and the smallest length norm
``m`` below it; the score grows with the counts and falls with ``m``, so the score
of such a document bounds all scores below. Every item goes down the tree depth
first and leaves a subtree whose bound is below its ``top``-th score so far; equal
bounds are followed, since ties are decided by the id. The lists of the tasks are
merged in Spark.

Document counts and lengths are taken over all documents. Items go to the tasks in
blocks of at most ``BLOCK_BYTES`` of text, one after the other, so that neither the
driver nor a task holds a benchmark of any size; a single longer item is a block.

NULL and empty texts have no terms, match nothing and are not counted. Rows with
equal ``item_id`` (NULL is one of them) are one item with the terms of all of them;
every row of ``documents`` is a document, also under a repeated or NULL id, which
comes first among ties. Very long texts are read whole, other columns are not
looked at, and empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from defectlab.llm.common import store, to_batch

TOP = 50
BLOCK_BYTES = 4 << 20
LEAF_DOCS = 32
# Cells of a tree's table of largest counts, and non-zero counts of its documents.
MOST_CELLS, MOST_COUNTS = 8 << 20, 2 << 20
# Terms of the items searched for together.
GROUP_TERMS = 1 << 15
PARTS = 64

# Bytes of a term as themselves, A-Z as a-z, all others as blanks: matches then are what split() leaves.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
VECTORS = "doc_id long,n long,terms binary,counts binary"
FOUND = "item long,doc_id long,score long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _vectors(vocabulary: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and restricted counts of every document that has a term."""
    known = vocabulary.get
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            words = terms_of(text.as_py() or b"")
            if words:
                counts = Counter(map(known, words))
                counts.pop(None, None)
                rows.append((doc, len(words), np.fromiter(counts, "<i4", len(counts)).tobytes(), np.fromiter(counts.values(), "<i4", len(counts)).tobytes()))
        yield to_batch(list(zip(*rows, strict=True)) or [()] * 4, VECTORS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, their terms with repeats (term -1 and -2) and each term's documents, as sums of a task."""
    total, length, seen = 0, 0, np.zeros(0, dtype=np.int64)
    for batch in batches:
        total, length = total + batch.num_rows, length + sum(batch.column(0).to_pylist())
        own = np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4"))
        if len(own) > len(seen):
            seen = np.concatenate([seen, np.zeros(len(own) - len(seen), dtype=np.int64)])
        seen[: len(own)] += own
    held = np.flatnonzero(seen)
    yield to_batch([[-1, -2, *held.tolist()], [total, length, *seen[held].tolist()]], "term int,n long")


class Terms:
    """A block's terms, the commonest first, and what they weigh; the corpus's documents and length."""

    def __init__(self, n_terms: int, totals: dict[int, int]):
        self.total, self.length = totals.get(-1, 0), totals.get(-2, 0)
        seen = np.array([totals.get(t, 0) for t in range(n_terms)], dtype=np.int64)
        order = np.argsort(-seen, kind="stable")
        self.place = np.empty(n_terms, dtype=np.int64)
        self.place[order] = np.arange(n_terms)
        self.weight = np.array([math.floor(1000 * math.log((2 * self.total + 2) / (2 * df + 1))) for df in seen[order].tolist()], dtype=np.int64)

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * n * self.total) // self.length

    def parts(self, counts: np.ndarray, m: np.ndarray) -> np.ndarray:
        """What each term adds to a score."""
        counts = counts.astype(np.int64)
        return self.weight * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


class Items:
    """Some of a block's items, from ``first`` on, as runs of places of their terms."""

    def __init__(self, first: int, places: list[np.ndarray]):
        self.first = first
        self.flat = np.concatenate(places)
        self.sizes = np.array([len(p) for p in places], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(places)), self.sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def sums(self, parts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """For each row of ``parts``, the scores of the chosen items."""
        sizes = self.sizes[chosen]
        return np.add.reduceat(parts[:, self.flat[chosen[self.owner]]], np.cumsum(sizes) - sizes, axis=1)


def grouped(terms: Terms, items: list[list[int]]) -> list[Items]:
    """Items in runs of at most about ``GROUP_TERMS`` terms, which are searched for together."""
    runs: list[Items] = []
    held: list[np.ndarray] = []
    for i, own in enumerate(items):
        held.append(terms.place[own])
        if sum(map(len, held)) >= GROUP_TERMS or i + 1 == len(items):
            runs.append(Items(i + 1 - len(held), held))
            held = []
    return runs


class Tree:
    """The frequent-pattern tree of a slice of documents."""

    def __init__(self, weighed: Terms, docs: list, n: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]):
        width = len(weighed.weight)
        paths = []
        for own, of in zip(terms, counts, strict=True):
            places = weighed.place[own]
            order = np.argsort(places)
            paths.append((places[order], of[order]))
        # Big-endian bytes sort as the paths do, a path before those that go on from it.
        order = sorted(range(len(docs)), key=[p.astype(">u4").tobytes() for p, _ in paths].__getitem__)
        self.docs = [docs[i] for i in order]
        self.m = weighed.norm(n[order])
        lengths = np.array([len(paths[i][0]) for i in order], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        self.terms = np.concatenate([paths[i][0] for i in order]) if len(order) else np.zeros(0, np.int64)
        self.counts = np.concatenate([paths[i][1] for i in order]) if len(order) else np.zeros(0, np.int64)
        self.span: list[tuple[int, int]] = [(0, len(order))]
        self.below: list[list[int]] = []
        self._grow(lengths)
        self.most = np.zeros((len(self.span), width), dtype=np.int32)
        self.least = np.zeros(len(self.span), dtype=np.int64)
        for node in range(len(self.span) - 1, -1, -1):
            low, high = self.span[node]
            self.least[node] = self.m[low:high].min(initial=np.iinfo(np.int64).max)
            if self.below[node]:
                np.maximum.reduce([self.most[c] for c in self.below[node]], out=self.most[node])
            else:
                np.maximum.at(self.most[node], self.terms[self.start[low] : self.start[high]], self.counts[self.start[low] : self.start[high]])

    def _grow(self, lengths: np.ndarray) -> None:
        """Children of every node: runs of documents with equal next terms, small neighbours taken together."""
        depths, node = [0], 0
        while node < len(self.span):
            (low, high), depth = self.span[node], depths[node]
            cuts: list[int] = []
            while high - low > LEAF_DOCS and not cuts:
                longer = lengths[low:high] > depth
                if not longer.any():
                    break  # one path throughout
                following = np.full(high - low, -1, dtype=np.int64)
                following[longer] = self.terms[self.start[low:high][longer] + depth]
                cuts = (np.flatnonzero(following[1:] != following[:-1]) + low + 1).tolist()
                depth += not cuts
            children = []
            if cuts:
                begin = low
                for i, end in enumerate([*cuts, high]):
                    last = high if i + 1 >= len(cuts) else cuts[i + 1]
                    if end == high or last - begin > LEAF_DOCS:
                        children.append((begin, end))
                        begin = end
            self.below.append(list(range(len(self.span), len(self.span) + len(children))))
            self.span += children
            depths += [depth] * len(children)
            node += 1


class Best:
    """The best documents so far of every item of a group."""

    def __init__(self, terms: Terms, items: Items, top: int):
        self.terms, self.items, self.top = terms, items, top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(len(items))]
        self.least = np.ones(len(items), dtype=np.int64)  # a bound below this is of no use
        self.at_once = max(1, min(64, MOST_COUNTS // max(len(terms.weight), len(items.flat))))
        self.scored = 0

    def add(self, scores: np.ndarray, chosen: np.ndarray, docs: list) -> None:
        rows, columns = np.nonzero(scores >= self.least[chosen])
        for row, item, score in zip(rows.tolist(), chosen[columns].tolist(), scores[rows, columns].tolist(), strict=True):
            heap, doc = self.heaps[item], docs[row]
            entry = (score, (1 << 63) + 1 if doc is None else -doc)
            if len(heap) < self.top:
                heappush(heap, entry)
            else:
                heappushpop(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]

    def bounds(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        every, found = np.ones(len(self.items), dtype=bool), []
        for i in range(0, len(nodes), self.at_once):
            some = nodes[i : i + self.at_once]
            found.append(self.items.sums(self.terms.parts(tree.most[some], tree.least[some][:, None]), every))
        return np.concatenate(found)

    def search(self, tree: Tree) -> None:
        open_ = [(0, self.bounds(tree, [0])[0])]
        while open_:
            node, bound = open_.pop()
            active = bound >= self.least
            if not active.any():
                continue
            children = tree.below[node]
            if children:
                found = np.where(active, self.bounds(tree, children), 0)
                open_ += [(children[i], found[i]) for i in np.argsort(found.sum(axis=1), kind="stable").tolist()]
            else:
                self._leaf(tree, *tree.span[node], active)

    def _leaf(self, tree: Tree, low: int, high: int, active: np.ndarray) -> None:
        weight = self.terms.weight
        for first in range(low, high, min(LEAF_DOCS, self.at_once)):
            last = min(high, first + min(LEAF_DOCS, self.at_once))
            begin, end = tree.start[first], tree.start[last]
            row = np.repeat(np.arange(last - first), np.diff(tree.start[first : last + 1]))
            parts = np.zeros((last - first, len(weight)), dtype=np.int64)
            places, counts = tree.terms[begin:end], tree.counts[begin:end].astype(np.int64)
            parts[row, places] = weight[places] * ((1_000_000_000 * counts) // (1000 * counts + 20 * tree.m[first:last][row]))
            self.scored += (last - first) * int(active.sum())
            self.add(self.items.sums(parts, active), np.flatnonzero(active), tree.docs[first:last])

    def rows(self) -> list[tuple]:
        return [(self.items.first + i, None if d > 1 << 63 else -d, s) for i, heap in enumerate(self.heaps) for s, d in heap]


def _search(terms: Terms, items: list[Items], top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = [Best(terms, group, top) for group in items]
    most_docs = max(LEAF_DOCS, MOST_CELLS // max(1, len(terms.weight)) * LEAF_DOCS // 2)
    held: list[tuple] = []
    size = 0

    def close() -> None:
        nonlocal size
        if held:
            docs, n, own, counts = zip(*held, strict=True)
            tree = Tree(terms, list(docs), np.array(n, dtype=np.int64), list(own), list(counts))
            for group in best:
                group.search(tree)
        held.clear()
        size = 0

    for batch in batches:
        for doc, n, own, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not own:
                continue
            held.append((doc, n, np.frombuffer(own, "<i4"), np.frombuffer(counts, "<i4")))
            size += len(own) // 4
            if len(held) >= most_docs or size >= MOST_COUNTS:
                close()
    close()
    yield to_batch(list(zip(*(r for group in best for r in group.rows()), strict=True)) or [()] * 3, FOUND)


def _search_block(docs: DataFrame, block: DataFrame, top: int) -> DataFrame | None:
    """The best documents of the items of one block, which its size allows to hold."""
    spark = docs.sparkSession
    texts: dict[int | None, set[bytes]] = {}
    for row in block.collect():
        texts.setdefault(row["item_id"], set()).update(terms_of((row["text"] or "").encode("utf-8")))
    ids = [i for i, own in texts.items() if own]
    if not ids:
        return None
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))}
    vectors = store(docs.mapInArrow(partial(_vectors, vocabulary), VECTORS), "vectors")
    counted = vectors.select("n", "terms").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    totals = {r["term"]: r["n"] for r in counted.collect()}  # a row for each term of the block's items
    terms = Terms(len(vocabulary), totals)
    items = grouped(terms, [[vocabulary[t] for t in sorted(texts[i])] for i in ids])
    found = vectors.mapInArrow(partial(_search, terms, items, top), FOUND)
    numbered = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    # Tasks' lists are cut to ``top`` in parts first, so that no item's lists all meet in one task.
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(F.col("score").desc(), F.col("doc_id"))
    whole = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id"))
    found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    return found.join(F.broadcast(numbered), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents of every item."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    place = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = [f for b in range(blocks) if (f := _search_block(narrow, wanted.where(place == b), top)) is not None]
    if found:
        return reduce(DataFrame.unionByName, found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
