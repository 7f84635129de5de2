"""Continuous form of the ingest batch: new files in a landing folder, exactly once.

A batch is named after the files it holds, so a replayed micro-batch finds itself
published, and a query started afresh never meets another one's batches. Files whose
bytes are already stored are skipped, so restarts cannot double any row. Files of
another suffix, or over a size limit if one is set, are refused and logged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.ingest import files_id, ingest_batch
from ledgerloom.sources.store import Store, check_batch_id

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(
    spark: SparkSession, store: Store, path: str, checkpoint: str, name: str = "landing", max_bytes: int | None = None
) -> StreamingQuery:
    """Ingest what is in ``path`` now and was not ingested before, then stop."""
    check_batch_id(name)
    arriving = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(path)

    def ingest(files: DataFrame, number: int) -> None:
        # One instant per micro-batch, taken from the files so that a replay repeats it.
        newest = files.agg(F.max("modificationTime").alias("at")).first().at
        ingest_batch(spark, store, path, f"{name}-{files_id(files)}", newest, files=files, max_bytes=max_bytes)

    return (
        arriving.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
