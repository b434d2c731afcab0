"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlab.session import scratch_path

# Broadcast at most this much; beyond it the callers join or work in blocks.
BROADCAST_BYTES = 64 << 20
# Python values of so many rows at a time, whatever the size of an Arrow batch.
SLICE_ROWS = 512


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes split at exactly these six blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def text_udf(kind: str, start: Callable[[], Callable[[list], list]]) -> Callable[..., Column]:
    """A struct-valued column over whole texts, computed on Arrow batches.

    ``start()`` is called once for a task and returns the function that maps a
    list of values (NULL as None) to a list of tuples in the order of ``kind``.
    """
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for batch in batches:
            for i in range(0, max(1, len(batch)), SLICE_ROWS):  # only all rows together have to be as many as came in
                yield tuples_to_struct(work(batch.slice(i, SLICE_ROWS).to_pylist()), kind)
        pa.default_memory_pool().release_unused()

    return run


_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}


def arrow_fields(kind: str) -> list[pa.Field]:
    inner = kind[len("struct<") : -1] if kind.startswith("struct<") else kind
    found = []
    for part in inner.split(","):
        name, _, of = part.strip().replace(":", " ", 1).partition(" ")
        found.append(pa.field(name, _TYPES[of.strip()]))
    return found


def tuples_to_struct(rows: list[tuple], kind: str) -> pa.Array:
    fields = arrow_fields(kind)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)


def to_batch(columns: list, kind: str) -> pa.RecordBatch:
    """A record batch for ``mapInArrow`` with the columns in the order of ``kind``."""
    fields = arrow_fields(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that a lost executor costs one task, not the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
