"""Token ids as files of independent rANS blocks, written and read in parallel.

A folder holds two tables: ``table``, how often each id occurs over all
documents, and ``blocks``, one row per block with the documents it holds, its
words, checkpoints and checksum. Spark's committer writes both, so a lost
executor only repeats its own task and half-written files never show.

Documents stand in ascending id order: a bucket is a range of ids, blocks are
numbered within their bucket, and nothing overlaps. NULL ids come first; equal
ids stand together in an order of their own, and when one id fills several
ranges its rows are dealt over all of them. NULL and empty texts hold the end
id alone. Empty tables give empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from defectlab.llm.common import shuffle_width, store, to_batch
from defectlab.llm.rans import Frequencies, checked
from defectlab.llm.tokens import word_level

BLOCK_TOKENS = 1 << 20
END_ID = 2
# Bytes of text to a bucket at most, on average; buckets are as many as shuffle partitions or more.
BUCKET_BYTES = 64 << 20
COUNTED = -1
FIRST = -(1 << 63)

TOKENS = "bucket int,doc_id long,no_id boolean,tie long,n_tokens long,ids binary"
BLOCKS = (
    "bucket int,block int,start_in_bucket long,n_tokens long,crc long,doc_ids binary,lengths binary,"
    "no_ids binary,words binary,states binary,places binary"
)


def range_bounds(docs: DataFrame, key: str, pieces: int) -> list[int]:
    """Bounds of ``pieces`` ranges of about as many rows each; a value that fills several ranges repeats."""
    marks = [i / pieces for i in range(1, pieces)]
    if not marks:
        return []
    found = docs.select(F.coalesce(F.col(key), F.lit(FIRST)).alias("k")).agg(F.percentile_approx("k", marks, 20 * pieces)).first()[0]
    return list(found or [])


def _tokenise(path: str, bounds: list[int], end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of every text, and at the end, in bucket ``COUNTED``, how often a task has seen each id."""
    words, limits = word_level(path), np.array(bounds, dtype=np.int64)
    end = np.array([end_id], dtype="<u4").tobytes()
    narrow = words.size <= 1 << 16
    counts = np.zeros(max(words.size, end_id + 1), dtype=np.int64)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = [words.encode(t or "") + end for t in texts]
        keys = np.array([FIRST if i is None else i for i in ids], dtype=np.int64)
        ties = np.array([zlib.crc32(f) for f in found], dtype=np.int64)
        low, high = np.searchsorted(limits, keys, "left"), np.searchsorted(limits, keys, "right")
        buckets = low + ties % (high - low + 1)
        n = [len(f) // 4 for f in found]
        whole = np.frombuffer(b"".join(found), "<u4")
        counts += np.bincount(whole, minlength=len(counts))
        if narrow:
            whole, ends = whole.astype("<u2"), np.cumsum(n).tolist()
            found = [whole[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
        yield to_batch([buckets.astype(np.int32), keys, [i is None for i in ids], ties, n, found], TOKENS)
    seen = np.flatnonzero(counts)
    packed = np.stack([seen, counts[seen]]).astype("<i8").tobytes()
    yield to_batch([[COUNTED], [0], [False], [0], [len(seen)], [packed]], TOKENS)


def _unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' counts as rows: at most one for each id of the vocabulary and task."""
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            seen, n = np.frombuffer(packed, "<i8").reshape(2, -1)
            yield to_batch([seen, n], "id long,n long")


def _encode(counts: np.ndarray, block_tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = Frequencies(counts)
    bucket, block, done = None, 0, 0
    ids: list[np.ndarray] = []
    docs: list[int] = []
    nulls: list[bool] = []

    def close() -> pa.RecordBatch:
        nonlocal block, done
        whole = np.concatenate(ids).astype(np.uint32)
        made = table.encode(whole)
        lengths = np.array([len(i) for i in ids], dtype="<i8")
        row = [
            bucket, block, done, len(whole), zlib.crc32(whole.astype("<u4").tobytes()), np.array(docs, "<i8").tobytes(), lengths.tobytes(),
            np.array(nulls, np.uint8).tobytes(), made["words"].astype("<u4").tobytes(), made["states"].astype("<u8").tobytes(),
            made["places"].astype("<i8").tobytes(),
        ]
        block, done = block + 1, done + len(whole)
        ids.clear(), docs.clear(), nulls.clear()
        return to_batch([[v] for v in row], BLOCKS)

    held = 0
    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for r in range(batch.num_rows):
            own, doc, no_id, n, packed = (c[r].as_py() for c in columns)
            if own != bucket or held >= block_tokens:
                if ids:
                    yield close()
                held = 0
                if own != bucket:
                    bucket, block, done = own, 0, 0
            ids.append(_unpacked(packed, n))
            docs.append(doc)
            nulls.append(no_id)
            held += n
    if ids:
        yield close()


def write(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Tokenise, count over all documents, then encode each range of ids by itself."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pieces = max(shuffle_width(spark), -(-size // BUCKET_BYTES))
    bounds = range_bounds(narrow, "doc_id", pieces)
    tokens = store(narrow.mapInArrow(partial(_tokenise, vocabulary, bounds, end_id), TOKENS), "ids")
    counted = tokens.where(F.col("bucket") == COUNTED).select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted.write.parquet(f"{folder}/table")
    counts = read_counts(spark, folder)  # at most a row for each id of the vocabulary
    (
        tokens.where(F.col("bucket") != COUNTED)
        .repartition(pieces, "bucket")
        .sortWithinPartitions("bucket", "doc_id", F.col("no_id").desc(), "tie")
        .select("bucket", "doc_id", "no_id", "n_tokens", "ids")
        .mapInArrow(partial(_encode, counts, block_tokens), BLOCKS)
        .write.option("compression", "uncompressed")
        .parquet(f"{folder}/blocks")
    )


def read_counts(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/table").collect()
    counts = np.zeros(max([r["id"] for r in rows], default=-1) + 1, dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def _decode(counts: np.ndarray, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = Frequencies(counts)
    for batch in batches:
        for row in batch.to_pylist():
            block = {
                "words": np.frombuffer(row["words"], "<u4"),
                "states": np.frombuffer(row["states"], "<u8"),
                "places": np.frombuffer(row["places"], "<i8"),
            }
            ids = checked(table.decode(block, row["n_tokens"]), row["crc"]).astype("<u4")
            lengths = np.frombuffer(row["lengths"], "<i8")
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            no_ids = np.frombuffer(row["no_ids"], np.uint8)
            docs = [None if z else int(d) for d, z in zip(np.frombuffer(row["doc_ids"], "<i8"), no_ids, strict=True)]
            parts = [ids[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
            yield to_batch(
                [docs, starts + row["base"], lengths, [zlib.crc32(p) for p in parts], parts if with_ids else [None] * len(parts)],
                "doc_id long,start long,n_tokens long,ids_crc32 long,ids binary",
            )


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, its ids; every block checked."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # A row per bucket of about BUCKET_BYTES of text: small enough for one running sum.
    totals = blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = blocks.join(F.broadcast(bases), "bucket").withColumn("base", F.col("before") + F.col("start_in_bucket"))
    counts = read_counts(spark, folder)
    decoded = placed.select("n_tokens", "crc", "doc_ids", "lengths", "no_ids", "words", "states", "places", "base").mapInArrow(
        partial(_decode, counts, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )
    return decoded if with_ids else decoded.drop("ids")
