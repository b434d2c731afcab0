"""Ids against the libraries, byte for byte; files read back."""

import base64
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from defectlab.llm import binary, bpe, rans
from defectlab.llm.tokens import byte_level, word_level

BYTE, WORD, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    with open(BYTE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(WORD)
    made.encode_special_tokens = True
    return made


def odd_texts():
    draw = random.Random(5)
    letters = "aaabbc   \n\n\t.,'s'll!!\xa0 éÀ́İıſßΣς　\x1c\x85中文🙂‍♂️ǅ١3½²<|endoftext|>\r"
    found = ["".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(3000)]
    return found + [c * n for c in "abc =-_.*#01 \n" for n in range(1, 60)]


def test_byte_level(docs, reference):
    codec = byte_level(BYTE, PATTERN)
    for text in [r["text"] for r in docs.select("text").collect()] + odd_texts():
        ids = codec.encode(text)
        assert list(array("I", ids)) == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_word_level(docs, library):
    codec = word_level(WORD)
    for text in [r["text"] for r in docs.limit(60).select("text").collect()] + odd_texts():
        assert list(array("I", codec.encode(text))) == library.encode(text, add_special_tokens=False).ids


def test_latin_texts_are_cut_as_the_library_does(library):
    """All Latin-1 characters beside each other, and a table too small to keep anything."""
    codec = word_level(WORD)
    draw = random.Random(8)
    chars = [chr(i) for i in range(256)]
    texts = ["".join(draw.choice(chars) for _ in range(40)) for _ in range(2000)]
    texts += [a + b for a in "aA1²_'\x1c \xa0ª½ß" for b in chars] + ["it's I'LL we've o'clock ''s 's's can't_x a_b __"]
    small = type(codec)(WORD)
    small.pieces.most = 3
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert list(array("I", codec.encode(text))) == list(array("I", small.encode(text))) == want, text


def test_offsets_of_split_characters():
    codec = byte_level(BYTE, PATTERN)
    text = "a🙂b 中"
    ids = codec.encode(text)
    starts, ends = codec.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text)
    assert set(range(len(text))) == {i for a, b in zip(starts, ends, strict=True) for i in range(a, b)}


def test_small_tables_change_nothing(monkeypatch):
    codec = byte_level(BYTE, PATTERN)
    texts = odd_texts()[:300]
    whole = [codec.encode(t) for t in texts]
    monkeypatch.setattr(codec.pieces, "most", 3)
    monkeypatch.setattr(codec.chunks, "most", 2)
    assert [codec.encode(t) for t in texts] == whole


def test_columns(odd_docs, no_docs):
    rows = bpe.round_trip(odd_docs, BYTE, PATTERN).collect()
    assert len(rows) == odd_docs.count()
    assert all(bytes(r["_decoded"]) == (r["text"] or "").encode() for r in rows)
    assert bpe.round_trip(no_docs, BYTE, PATTERN).collect() == []
    apart = odd_docs.select("text", bpe.encode(F.col("text"), BYTE, PATTERN, offsets=True).alias("e")).withColumn("d", bpe.decode(F.col("e.ids"), BYTE))
    for r in apart.collect():
        assert bytes(r["d"]) == (r["text"] or "").encode()
        assert len(r["e"]["starts"]) == len(r["e"]["ids"]) // 4


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 300_000, 600_001])
def test_rans_round_trip(n):
    draw = np.random.default_rng(n)
    ids = np.minimum(draw.zipf(1.3, n), 49_407).astype(np.uint32)
    table = rans.Frequencies(np.bincount(ids, minlength=10))
    block = table.encode(ids)
    assert np.array_equal(table.decode(block, n), ids)
    for c in range(len(block["places"])):  # every checkpoint is a place to start
        start = c * rans.CHECKPOINT * rans.LANES
        assert np.array_equal(table.decode(block, n, c), ids[start:])
    if n:
        with pytest.raises(ValueError):
            rans.checked(ids, zlib.crc32(ids.tobytes()) ^ 1)


def test_rans_needs_little_space():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 400_000), 49_407).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 * len(ids)
    assert rans.Frequencies(np.bincount(ids)).encode(ids)["words"].nbytes < 1.02 * entropy + 8 * rans.LANES


@pytest.mark.parametrize("block_tokens", [50, 1 << 20])
def test_files(spark, docs, library, tmp_path, block_tokens):
    some = docs.limit(80).repartition(3)
    binary.write(some, str(tmp_path / "f"), WORD, block_tokens=block_tokens)
    rows = {r["doc_id"]: r for r in binary.read(spark, str(tmp_path / "f")).collect()}
    at = 0
    for r in sorted(some.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"], bytes(got["ids"])) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert len(rows) == 80


def test_files_of_odd_rows(spark, odd_docs, no_docs, library, tmp_path):
    binary.write(odd_docs, str(tmp_path / "odd"), WORD)
    rows = sorted(binary.read(spark, str(tmp_path / "odd")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([r["doc_id"] for r in odd_docs.collect()], key=lambda i: (i is not None, i or 0))
    ends = [r["start"] + r["n_tokens"] for r in rows]
    assert [r["start"] for r in rows] == [0, *ends[:-1]]
    want = sorted(zlib.crc32(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in odd_docs.collect())
    assert sorted(r["ids_crc32"] for r in rows) == want
    binary.write(no_docs, str(tmp_path / "none"), WORD)
    assert binary.read(spark, str(tmp_path / "none")).collect() == []


def test_one_id_fills_several_ranges(spark, tmp_path):
    df = spark.createDataFrame([(7, f"text {i}") for i in range(60)] + [(i, "x") for i in range(20)], "doc_id long, text string")
    binary.write(df, str(tmp_path / "hot"), WORD, block_tokens=16)
    rows = sorted(binary.read(spark, str(tmp_path / "hot")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in df.collect())
    assert spark.read.parquet(str(tmp_path / "hot/blocks")).filter("n_tokens > 0").select("bucket").distinct().count() > 3
