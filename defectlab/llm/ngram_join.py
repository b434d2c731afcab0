"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A text's set holds the hashes of its distinct word n-grams; texts with equal
sets are one node. All n-grams share one order: rare first by a sketch that
counts every n-gram of every text, then by hash. Two sets whose Jaccard
similarity reaches the threshold have an overlap of at least ``a`` (known from
their sizes), so the first ``n - a + l`` n-grams of both share at least ``l``,
for any ``l``. Each node takes the ``l`` that its estimated candidates make
cheapest: a longer prefix costs postings, a higher ``l`` saves verifications.

Pairs meet at prefix n-grams. N-grams in at most ``COLD`` prefixes yield their
pairs directly. A more frequent one first links its nodes to one of them; only
pairs whose nodes are then still in different components, of sizes and prefix
places that allow a link, are formed. So copies cost a row each, and no link
between components is missed. Candidates are verified on whole sets.

Sets are compared by 64-bit hashes. Texts of fewer words than ``n`` have one
n-gram, their whole sequence; NULL, empty and blank texts have none and link
with nothing. Repeated rows link with each other; ids may repeat or be NULL (a
NULL id is never the smallest). An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.llm.common import BROADCAST_BYTES, store, to_batch

COLD = 16
MOST_MATCHES = 8
VERIFY_COST = 20.0
SKETCH_BITS = 21
SEGMENTS = 64
MOST_WORDS = 100_000
SLICE = 256
NO_KEY = -(1 << 63)


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


_WORDS = _WordHashes()


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; only A to Z are lower-cased."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = [len(w) for w in split]
    flat = np.fromiter((h for w in split for h in map(_WORDS.__getitem__, w)), dtype=np.uint64, count=sum(sizes))
    found, at = [], 0
    mixed = np.zeros(max(0, len(flat) - n + 1), dtype=np.uint64)
    for k in range(n):
        mixed = _mix(mixed ^ flat[k : len(flat) - n + 1 + k]) if len(mixed) else mixed
    for size in sizes:
        if size >= n:
            found.append(np.unique(mixed[at : at + size - n + 1]))
        elif size:
            whole = np.full(1, size, dtype=np.uint64)
            for h in flat[at : at + size]:
                whole = _mix(whole ^ h)
            found.append(whole)
        else:
            found.append(flat[:0])
        at += size
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(batches: Iterator[pa.RecordBatch]):
    """Columns of a few rows at a time; a task leaves no table of words behind in its worker."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield [c.to_pylist() for c in batch.slice(i, SLICE).columns]
    _WORDS.clear()
    pa.default_memory_pool().release_unused()


def _sketch(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many n-grams of a task's texts fall in each place of the sketch, in segments."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for (texts,) in _slices(batches):
        sets = shingle_sets(texts, n)
        places, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
        counts[places.astype(np.int64)] += times.astype(np.uint32)
    parts = counts.reshape(SEGMENTS, -1)
    if counts.any():
        yield to_batch([list(range(SEGMENTS)), [zlib.compress(p.tobytes(), 1) for p in parts]], "segment int,counts binary")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32).astype(np.int64)
            sums[segment] = sums[segment] + own if segment in sums else own
    yield to_batch([list(sums), [zlib.compress(np.minimum(s, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for s in sums.values()]], "segment int,counts binary")


def frequency_sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Counts of all n-grams of all texts by the first bits of their hash; a fixed number of places."""
    kind = "segment int, counts binary"
    parts = texts.mapInArrow(partial(_sketch, n), kind)
    merged = parts.repartition(SEGMENTS, "segment").mapInArrow(_merge, kind).collect()
    found = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS), dtype=np.uint32)
    for r in merged:
        found[r["segment"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return found.ravel()


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def matches_wanted(costs: np.ndarray, base: int) -> int:
    """The number of shared prefix n-grams that makes a node's candidates cheapest; ``base`` is the prefix for one."""
    sums = np.cumsum(costs)
    most = min(MOST_MATCHES, len(costs) - base + 1)
    total = [sums[base + k - 2] * (1 + VERIFY_COST / k**2) for k in range(1, most + 1)]
    return int(np.argmin(total)) + 1


def _prefixes(shared, n: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text its node, the size of its set, the matches it wants and its prefix in the common order."""
    sketch = shared.value
    usual = float(sketch.mean())
    for keys, texts in _slices(batches):
        nodes, sizes, wanted, prefixes = [], [], [], []
        for hashes in shingle_sets(texts, n):
            size = len(hashes)
            sizes.append(size)
            if not size:
                nodes.append(None), wanted.append(0), prefixes.append([])
                continue
            nodes.append(node_of(hashes))
            count = sketch[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            base = size - -(-percent * size // 100) + 1
            longest = min(size, base + MOST_MATCHES - 1)
            if longest < size:
                near = np.flatnonzero(count <= np.partition(count, longest - 1)[longest - 1])
            else:
                near = np.arange(size)
            order = near[np.lexsort((hashes[near], count[near]))][:longest]
            k = matches_wanted(np.maximum(count[order] - usual, 0.1), base)
            wanted.append(k)
            prefixes.append(_signed(hashes[order[: base + k - 1]]))
        yield to_batch([keys, nodes, sizes, wanted, prefixes], "key long,node long,n int,wanted int,prefix array<long>")


def _sets(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (texts,) in _slices(batches):
        sets = [h for h in shingle_sets(texts, n) if len(h)]
        yield to_batch([[node_of(h) for h in sets], [_signed(h) for h in sets]], "node long,hashes array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, for all nodes with an edge ``(u, v)``.

    Alternates between hanging larger neighbours and smaller neighbours on the
    smallest one until nothing changes; each round is written down.
    """
    u, v = F.col("u"), F.col("v")
    now = store(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), u).alias("low"))
        large = both.join(lowest, "u").filter(v > u).select(v.alias("u"), F.col("low").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").filter(v != F.col("low")).select(v.alias("u"), F.col("low").alias("v"))
        now = store(small.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
    roots = now.select(v.alias("node"), v.alias("component")).distinct()
    return now.select(u.alias("node"), v.alias("component")).unionByName(roots)


def overlap_needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of sets of two sizes for a similarity of ``percent`` in a hundred."""
    return F.ceil((F.lit(percent) * (a + b)) / F.lit(100 + percent) - F.lit(1e-9))


def _may_link(percent: int, matches: Column | int | None = None) -> Column:
    """Sizes and places of a shared n-gram that a link allows, for columns of ``x`` and ``y``.

    Without ``matches`` the n-gram may be any of those the pair has to share;
    with 1 only the first of them, which stands before all others.
    """
    need = overlap_needed(F.col("x.n"), F.col("y.n"), percent)
    least = F.least("x.wanted", "y.wanted") if matches is None else F.lit(matches)
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    return sizes & (F.col("x.pos") < F.col("x.n") - need + least) & (F.col("y.pos") < F.col("y.n") - need + least)


def _sharing_enough(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes share as many n-grams as both want, counted on the prefixes of the pairs' own nodes."""
    own = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    prefix = F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("prefix")
    nodes = active.join(own, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("wanted").alias("wanted"), prefix)
    x, y = nodes.alias("x"), nodes.alias("y")
    both = pairs.join(x, F.col("u") == F.col("x.node")).join(y, F.col("v") == F.col("y.node"))
    least = F.least("x.wanted", "y.wanted")
    free = least - overlap_needed(F.col("x.n"), F.col("y.n"), percent)
    first = F.transform(F.filter("x.prefix", lambda t: t["pos"] < F.col("x.n") + free), lambda t: t["token"])
    second = F.transform(F.filter("y.prefix", lambda t: t["pos"] < F.col("y.n") + free), lambda t: t["token"])
    return both.filter(F.size(F.array_intersect(first, second)) >= least).select("u", "v")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` that reach the threshold on whole sets."""
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    joined = pairs.join(left, "u").join(right, "v")
    return joined.filter(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v")


def link_components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id its links reach."""
    spark = docs.sparkSession
    given = F.col(key).cast("long")
    rows = docs.select(F.coalesce(given, F.lit(NO_KEY)).alias("key"), F.col(text).cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(rows.select("text"), n))  # 4 << SKETCH_BITS bytes
    kind = "key long, node long, n int, wanted int, prefix array<long>"
    sized = store(rows.mapInArrow(partial(_prefixes, sketch, n, percent), kind), "prefixes")
    nodes = sized.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(F.nullif("key", F.lit(NO_KEY))).alias("rep"), F.first("n").alias("n"), F.first("wanted").alias("wanted"), F.first("prefix").alias("prefix")
    )
    postings = nodes.select("node", "n", "wanted", F.posexplode("prefix").alias("pos", "token"))
    met = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    active = store(postings.join(met, "token"), "postings")

    hot = active.filter(F.col("df") > COLD)
    hot_in = hot.groupBy("node").agg(F.count("*").alias("hot"))
    cold = active.filter(F.col("df") <= COLD)
    met_cold = cold.alias("x").join(cold.alias("y"), "token").filter((F.col("x.node") < F.col("y.node")) & _may_link(percent))
    counted = met_cold.groupBy(F.col("x.node").alias("u"), F.col("y.node").alias("v")).agg(
        F.count("*").alias("cold"), F.first(F.least("x.wanted", "y.wanted")).alias("least")
    )
    sure = counted.filter("cold >= least").select("u", "v")
    maybe = (
        counted.filter("cold < least")
        .join(hot_in.withColumnRenamed("node", "u").withColumnRenamed("hot", "hot_u"), "u")
        .join(hot_in.withColumnRenamed("node", "v").withColumnRenamed("hot", "hot_v"), "v")
        .filter(F.col("cold") + F.least("hot_u", "hot_v") >= F.col("least"))
        .select("u", "v")
    )
    pivots = hot.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("pivot"))
    near = 100 * F.least("n", F.col("pivot.n")) >= percent * F.greatest("n", F.col("pivot.n"))
    stars = hot.join(pivots, "token").filter((F.col("node") != F.col("pivot.node")) & near)
    stars = stars.select(F.least("node", F.col("pivot.node")).alias("u"), F.greatest("node", F.col("pivot.node")).alias("v"))
    pairs = store(sure.unionByName(maybe).unionByName(stars).distinct(), "pairs")

    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(hot_in.select("node")).distinct()
    sets = store(_sets_of(rows, sized, wanted, n), "sets")
    first = components(_verified(pairs, sets, percent))

    placed = store(hot.join(first, "node", "left").withColumn("component", F.coalesce("component", "node")), "hot")
    split = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    apart = placed.join(split, "token")
    across = apart.alias("x").join(apart.alias("y"), "token").filter(
        (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _may_link(percent, 1)
    )
    rest = store(across.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti"), "rest")
    rest = _sharing_enough(rest, active, percent)
    links = store(_verified(rest, sets, percent), "links")
    more = first.select(F.col("node").alias("u"), F.col("component").alias("v"))
    final = components(more.unionByName(links)) if not links.isEmpty() else first

    reps = nodes.select("node", "rep").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = reps.join(smallest, "component").select("node", "component_id")
    own = F.nullif("key", F.lit(NO_KEY))
    return sized.join(labels, "node", "left").select(
        own.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id")
    )


def links(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: pairs ``(u, v)`` of nodes, ``u < v``, and the membership ``(doc_id, node)`` of all rows.

    Rows of one node are copies and link with each other; a NULL node links with
    nothing. Unlike for components no pair is left to others: any two nodes meet
    at the first n-gram they share, within the sizes and places a link allows,
    and Spark splits the parts of a frequent one. There are as many pairs as
    links, so near copies of many different texts make many.
    """
    spark = docs.sparkSession
    given = F.col(key).cast("long")
    rows = docs.select(F.coalesce(given, F.lit(NO_KEY)).alias("key"), F.col(text).cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(frequency_sketch(rows.select("text"), n))
    kind = "key long, node long, n int, wanted int, prefix array<long>"
    sized = store(rows.mapInArrow(partial(_prefixes, sketch, n, percent), kind), "prefixes")
    nodes = sized.filter("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("wanted").alias("wanted"), F.first("prefix").alias("prefix"))
    postings = store(nodes.select("node", "n", "wanted", F.posexplode("prefix").alias("pos", "token")), "postings")
    x, y = postings.alias("x"), postings.alias("y")
    met = x.join(y, "token").filter((F.col("x.node") < F.col("y.node")) & _may_link(percent, 1))
    pairs = store(met.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct(), "pairs")
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = store(_sets_of(rows, sized, wanted, n), "sets")
    members = sized.select(F.nullif("key", F.lit(NO_KEY)).alias("doc_id"), "node")
    return store(_verified(_sharing_enough(pairs, postings, percent), sets, percent), "links"), members


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``doc_id`` and ``n_links``, to how many other rows it links, of every row; from both results of ``links``."""
    sizes = store(members.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("rows")), "sizes")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    other = both.join(sizes.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.sum("rows").alias("other"))
    of_node = sizes.join(other.withColumnRenamed("u", "node"), "node", "left")
    of_node = of_node.select("node", (F.col("rows") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"))
    return members.join(of_node, "node", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _sets_of(rows: DataFrame, sized: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Whole sets of the wanted nodes, each from one text."""
    chosen = sized.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key").distinct()
    chosen = store(chosen, "wanted")
    few = chosen.count() * 64 <= BROADCAST_BYTES
    texts = rows.join(F.broadcast(chosen) if few else chosen, "key", "left_semi").select("text")
    return texts.mapInArrow(partial(_sets, n), "node long, hashes array<long>").dropDuplicates(["node"])
