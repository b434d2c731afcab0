"""Appends that can be repeated: a manifest says which batches count.

A batch is written to a folder of its own and listed after that. A batch that is
not listed, because its job was killed, is not read, and doing it again overwrites
it; doing a listed one again changes nothing. Truncating starts a new generation
beside the old one, which readers leave the moment the new one is listed. Spark
moves a finished file into place in one step, so an entry is there or it is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from defectlab.operators.models import rows_at

ENTRY = "generation int, batch string"
START = ""


def _listed(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The current generation and its batches."""
    rows = rows_at(spark, f"{path}/manifest", ENTRY)
    current = max((r["generation"] for r in rows), default=0)
    return current, sorted({r["batch"] for r in rows if r["generation"] == current} - {START})


def _list(spark: SparkSession, path: str, generation: int, batch: str) -> None:
    entry = spark.createDataFrame([(generation, batch)], ENTRY)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def start_over(spark: SparkSession, path: str) -> None:
    """Truncate: from now on readers see the batches appended after this."""
    current, _ = _listed(spark, path)
    _list(spark, path, current + 1, START)


def append_batch(df: DataFrame, path: str, batch: str, write: Callable[[DataFrame, str], None]) -> bool:
    """Write ``df`` as ``batch`` (a name that stays the same when the job is repeated); False where it is listed already.

    ``write(df, folder)`` overwrites ``folder``, as ``write_changes`` and ``write_runs`` do.
    """
    spark = df.sparkSession
    generation, batches = _listed(spark, path)
    if batch in batches:
        return False
    write(df, _folder(path, generation, batch))
    _list(spark, path, generation, batch)
    return True


def read_batches(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame | None:
    """All listed batches, each by ``read(spark, folder)``; None where there is none."""
    generation, batches = _listed(spark, path)
    found = None
    for batch in batches:
        part = read(spark, _folder(path, generation, batch))
        found = part if found is None else found.unionByName(part)
    return found


def _folder(path: str, generation: int, batch: str) -> str:
    return f"{path}/generation={generation}/{batch}"
