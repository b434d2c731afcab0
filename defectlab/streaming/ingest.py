"""Change pairs kept current as commit payloads land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from defectlab.operators.changes import FILE_KEY, change_pairs, first_in_payload
from defectlab.sources.readers import COMMIT_SCHEMA

OUTPUT_SCHEMA = (
    "repository string, commit_id string, filepath string, deleted_lines string, added_lines string, batch int"
)


def stream_changes(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    worklist: DataFrame | None = None,
    mode: str = "strict",
    files_per_batch: int | None = None,
    keep: str | None = "365 days",
) -> StreamingQuery:
    """Start a run over everything that has landed since the last one.

    A file of a commit is written once. Which keys have been seen is held in the
    query's keyed state, spread over the shuffle partitions: a batch looks up its
    own keys there and reads nothing of what earlier batches wrote. A key is
    forgotten ``keep`` after its batch (None: never), and a payload that lands
    again later than that is taken as new. Inside a payload the first file of a
    name counts; copies of a commit's file in several payloads are the same file.
    ``spark.sql.streaming.stateStore.providerClass`` sets where state lives; large
    tables want the RocksDB one.

    Each micro-batch owns the folder ``batch=N`` of ``out`` and overwrites it, and a
    batch repeated after a failure starts from the state before it, so it leaves
    the same rows. With ``worklist``, only files it names are kept. A run takes all
    new files as one batch unless ``files_per_batch`` limits it. ``out`` and
    ``checkpoint`` belong together: drop both or neither.
    """

    def land(files: DataFrame, batch: int) -> None:
        change_pairs(files.drop("landed"), mode).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    reader = spark.readStream.schema(COMMIT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = first_in_payload(reader.json(landing))
    if worklist is not None:
        files = files.join(worklist.select(*FILE_KEY).distinct(), FILE_KEY, "left_semi")
    if keep is None:
        unseen = files.dropDuplicates(FILE_KEY)
    else:  # the batch's own time: no payload is ever too late
        unseen = files.withColumn("landed", F.current_timestamp()).withWatermark("landed", keep).dropDuplicatesWithinWatermark(FILE_KEY)
    return (
        unseen.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """The change table written so far."""
    return spark.read.schema(OUTPUT_SCHEMA).parquet(out)
