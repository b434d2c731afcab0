"""Source divergence audit: how far the sources of a language are apart, and the terms that set each one apart.

Every source of a language is a smoothed distribution over the language's kept
terms, in whole billionths. Two sources differ by the sum of ``|p - q|`` over all
kept terms. Most cells are zero, so the sum is taken as what it would be if all
counts were zero, plus corrections for the cells that are not:

* a cell of one source changes its term's share against every other source;
  cells of one source with equal counts correct alike and are counted first,
* two cells of one term correct each other once more. Term rows, the non-zero
  cells of a term in one order of sources, go into a frequent-pattern tree.
  Rows that begin alike share a path, and a node with multiplicity ``m`` adds
  ``m`` times its correction against each of its ancestors.

Rows are sorted by path in ranges, so a task holds one open path of the tree and
closes each node when the next row leaves it; no tree is ever held whole. A path
cut by a range bound only splits a multiplicity into two summands.

NULL text, lang and source are ``''``. Empty texts have no terms; a group without
kept terms is still compared. Ties are ranked by the bytes of the item. Repeated
rows count as often as they occur, very long texts are counted whole, other
columns are not looked at, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectlab.llm.common import shuffle_width, store, to_batch

MIN_DOCS = 30
TERM_RANKS = 50
UNIT, PRIOR = 1_000_000_000, 5
# A task hands on its counts when it holds so many, and its corrections likewise.
MOST_COUNTS = 400_000
MOST_CORRECTIONS = 1 << 20
HEAD = 2

# Bytes of a term as themselves, A-Z as a-z, all others as blanks: matches then are what split() leaves.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string,source string,term string,n long,docs long"
PAIRS = "lang string,a string,b string,v long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, added up within a task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def counts() -> Iterator[pa.RecordBatch]:
        for (lang, source), (all_, docs) in held.items():
            terms = pa.array(list(all_), pa.binary()).cast(pa.string())
            columns = [terms, pa.array(list(all_.values()), pa.int64()), pa.array(list(map(docs.__getitem__, all_)), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(all_), pa.string()) for name in (lang, source)] + columns, names=["lang", "source", "term", "n", "docs"]
            )
        held.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            words = text.as_py().translate(FOLD).split()
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            all_, docs = held[lang, source]
            before = len(all_)
            all_.update(words)
            docs.update(set(words))
            size += len(all_) - before
            if size > MOST_COUNTS:
                yield from counts()
                size = 0
    yield from counts()


def _share(count: str, total: str) -> Column:
    """``1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * V))``; 0 for a language without kept terms."""
    return F.expr(f"CASE WHEN V > 0 THEN 1 + (CAST({count} + {PRIOR} AS DECIMAL(20, 0)) * {UNIT}) div ({total} + {PRIOR} * V) ELSE 0L END")


class _OpenPath:
    """The path of the tree that leads to the current row, and the corrections of the nodes already closed."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.depth = 0
        self.source, self.n, self.p, self.z = (np.zeros(16, dtype=np.int64) for _ in range(4))
        self.rows = [0] * 16
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def number(self, sources: list[str]) -> np.ndarray:
        return np.array([self.ids.setdefault(s, len(self.ids)) for s in sources], dtype=np.int64)

    def close(self, depth: int) -> None:
        """Leave all nodes below ``depth``; each corrects itself against its ancestors, ``rows`` times."""
        for d in range(self.depth - 1, depth - 1, -1):
            m = self.rows[d]
            if d:
                self.rows[d - 1] += m
                p, z, ps, zs = self.p[d], self.z[d], self.p[:d], self.z[:d]
                own = np.abs(p - ps) - np.abs(p - zs) - np.abs(z - ps) + np.abs(z - zs)
                self.found.append(((self.source[d] << 32) | self.source[:d], own * m))
                self.held += d
        self.depth = min(self.depth, depth)

    def enter(self, source: np.ndarray, n: np.ndarray, p: np.ndarray, z: np.ndarray, rows: int) -> None:
        most = min(self.depth, len(source))
        differ = np.flatnonzero((self.source[:most] != source[:most]) | (self.n[:most] != n[:most]))
        shared = int(differ[0]) if len(differ) else most
        self.close(shared)
        while len(self.rows) < len(source):
            self.source, self.n, self.p, self.z = (np.concatenate([a, np.zeros_like(a)]) for a in (self.source, self.n, self.p, self.z))
            self.rows += [0] * len(self.rows)
        end = len(source)
        for held, new in ((self.source, source), (self.n, n), (self.p, p), (self.z, z)):
            held[shared:end] = new[shared:]
        self.rows[shared:end] = [0] * (end - shared)
        self.rows[end - 1] += rows
        self.depth = end

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        """The corrections so far, one for each pair of sources."""
        keys, values = (np.concatenate([f[i] for f in self.found]) if self.found else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, values = keys[first], np.add.reduceat(values, first) if len(first) else values
        self.found, self.held = [(keys, values)], len(keys)
        return keys, values


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair corrections of rows that come sorted by language and path."""
    path, lang = _OpenPath(), None

    def summed() -> pa.RecordBatch:
        keys, values = path.summed()
        names = list(path.ids)
        path.found, path.held = [], 0
        a, b = ([names[i] for i in k.tolist()] for k in (keys >> 32, keys & 0xFFFFFFFF))
        return to_batch([[lang] * len(keys), a, b, values], PAIRS)

    for batch in batches:
        cells, ends = batch.column(1).flatten(), np.cumsum(batch.column(1).value_lengths().to_numpy())
        source = path.number(cells.field("source").to_pylist())
        n, p, z = (cells.field(f).to_numpy() for f in ("n", "p", "z"))
        start = 0
        for own, end, rows in zip(batch.column(0).to_pylist(), ends.tolist(), batch.column(2).to_pylist(), strict=True):
            if own != lang:
                path.close(0)
                if path.found:
                    yield summed()
                lang = own
            path.enter(source[start:end], n[start:end], p[start:end], z[start:end], rows)
            start = end
            if path.held > MOST_CORRECTIONS:
                path.summed()
                if path.held > MOST_CORRECTIONS // 2:
                    yield summed()
    path.close(0)
    if path.found:
        yield summed()


def _against_zero(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each source its cells' corrections against every other source's share of an absent term."""
    for batch in batches:
        for row in batch.to_pylist():
            p, n = (np.array([c[f] for c in row["profile"] or ()], dtype=np.int64) for f in ("p", "n"))
            order = np.argsort(p)
            p, n = p[order], n[order]
            names = [o["source"] for o in row["others"]]
            z = np.array([o["z"] for o in row["others"]], dtype=np.int64)
            below = np.searchsorted(p, z, "right")
            many, sums = (np.concatenate([[0], np.cumsum(a)]) for a in (n, n * p))
            apart = np.abs(z - row["z"])
            value = many[below] * z - sums[below] + (sums[-1] - sums[below]) - (many[-1] - many[below]) * z - many[-1] * apart
            first = np.array([row["source"] < o for o in names])
            value += np.where(first, row["V"] * apart, 0)  # all terms as if both counts were zero, once for each pair
            own = [i for i, o in enumerate(names) if o != row["source"]]
            yield to_batch([[row["lang"]] * len(own), [row["source"]] * len(own), [names[i] for i in own], value[own]], PAIRS)


def term_rows(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text") -> DataFrame:
    """``lang``, ``term``, ``total`` and the non-zero ``cells`` (source, n) of every term in at least ``min_docs`` documents of its language."""
    narrow = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (("lang", "lang"), ("source", "source"), (text, "text"))])
    # Tasks have added up their own counts, which is why these are dealt out before they are grouped.
    dealt = narrow.mapInArrow(_count_terms, COUNTS).repartition("lang", "source", "term")
    counts = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return rows.where(F.col("docs") >= min_docs)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """Per group (``lang``, ``source``): the other sources by distance (``pair``) and the terms above the language's share (``term``)."""
    rows = store(term_rows(docs, min_docs), "term-rows")
    flat = rows.select("lang", "term", "total", F.inline("cells"))
    kept = rows.groupBy("lang").agg(F.count("*").alias("V"), F.sum("total").alias("lang_total"))
    own = flat.groupBy("lang", "source").agg(F.sum("n").alias("own_total"), F.count("*").alias("held"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(own, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["own_total", "held", "V", "lang_total"])
    groups = store(groups.withColumn("z", _share("0", "own_total")), "term-groups")

    cells = flat.join(groups, ["lang", "source"]).withColumn("p", _share("n", "own_total"))
    shares = cells.withColumn("value", F.col("p") - _share("total", "lang_total")).where("value > 0")
    terms = _ranked(shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")).where(F.col("rank") <= term_ranks)

    # The commonest sources stand first, so that rows share the longest paths.
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("held")).alias("place"), "source", "n", "p", "z")))
    paths = cells.groupBy("lang", "term").agg(ordered.alias("path")).groupBy("lang", "path").agg(F.count("*").alias("m"))
    # Ranges are drawn by the heads of the paths, which are short; rows of a common head part by a hash.
    head = F.transform(F.slice("path", 1, HEAD), lambda c: F.struct(c["place"], c["source"], c["n"]))
    ranges = paths.repartitionByRange(shuffle_width(docs.sparkSession), F.col("lang"), head, F.xxhash64("path"))
    paths = ranges.sortWithinPartitions("lang", "path")
    both = paths.mapInArrow(_corrections, PAIRS)

    profile = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("profile"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "z")).alias("others"))
    one = groups.join(profile, ["lang", "source"], "left").join(others, "lang").select("lang", "source", "z", "V", "profile", "others").mapInArrow(_against_zero, PAIRS)

    pairs = one.unionByName(both).groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("v").alias("value"))
    sides = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", sides).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return _ranked(pairs).unionByName(terms)


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return df.withColumn("rank", F.row_number().over(order))
