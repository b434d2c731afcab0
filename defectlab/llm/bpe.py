"""Byte-level BPE encoding and decoding as columns.

NULL texts count as empty: no ids, no bytes. Empty texts give empty binaries,
texts of any length are encoded whole, other columns are left alone. The
vocabulary file is read where the worker runs; its path is a parameter.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.llm.common import text_udf
from defectlab.llm.tokens import byte_level, byte_table
from defectlab.llm.tokens import decode as decode_ids


def _encoder(path: str, pattern: str, offsets: bool):
    codec = byte_level(path, pattern)

    def work(texts):
        if not offsets:
            return [(codec.encode(t or ""),) for t in texts]
        ids = [codec.encode(t or "") for t in texts]
        return [(i, *codec.offsets(t or "", i)) for t, i in zip(texts, ids, strict=True)]

    return work


def _decoder(path: str):
    table = byte_table(path)
    return lambda found: [(decode_ids(table, i or b""),) for i in found]


def _both(path: str, pattern: str):
    codec = byte_level(path, pattern)

    def work(texts):
        ids = [codec.encode(t or "") for t in texts]
        return [(i, codec.decode(i)) for i in ids]

    return work


def encode(text: Column, path: str, pattern: str, offsets: bool = False) -> Column:
    """Struct ``ids`` (little-endian unsigned 32-bit) and, when asked for, ``starts`` and ``ends`` in code points."""
    kind = "struct<ids:binary,starts:array<int>,ends:array<int>>" if offsets else "struct<ids:binary>"
    return text_udf(kind, partial(_encoder, path, pattern, offsets))(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes of an id sequence; text is ``decode(...).cast("string")`` where the sequence ends between characters."""
    return text_udf("struct<bytes:binary>", partial(_decoder, path))(ids)["bytes"]


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``_ids`` and ``_decoded`` added, made in one pass over the text; rows and other columns stay.

    Columns of these names, and ``_both``, are replaced.
    """
    both = text_udf("struct<ids:binary,decoded:binary>", partial(_both, path, pattern))(F.col(text))
    return docs.withColumn("_both", both).withColumns({"_ids": F.col("_both.ids"), "_decoded": F.col("_both.decoded")}).drop("_both")
