"""Incremental ingest: each micro-batch of new files is upserted as one more table version.

The same idempotent upsert as the batch job, driven by a file stream: a batch that is replayed
after a failure upserts the same rows again and changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricway.operators.store import VersionedTable, create_buckets, ingest, ingest_buckets, last_of_batch


def document_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """New JSON-lines files of documents; `seq` is the time a file arrived, so later files win."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)
    return rows.withColumn("seq", F.struct(F.col("_metadata.file_modification_time").alias("at"),
                                           F.col("_metadata.file_path").alias("file"),
                                           F.col("_metadata.file_block_start").alias("offset")))


def upsert_stream(stream: DataFrame, table: VersionedTable, checkpoint: str, key: str = "call_id"):
    """Start a query that upserts every batch and stops when the waiting files are done."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        if not table.versions().filter(F.col("made_from") == f"stream batch {batch_id}").isEmpty():
            return  # a replayed batch is already published
        if table.newest():
            store = table.as_of()
        else:
            store = batch.drop("seq").limit(0)
        table.publish(ingest(store, batch, key), f"stream batch {batch_id}")

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def bucket_stream(stream: DataFrame, folder: str, checkpoint: str, key: str = "call_id", buckets: int = 64):
    """Like `upsert_stream`, into bucket folders: a batch rewrites only the buckets of its keys, and a batch that is replayed changes
    nothing, since stored rows carry their `seq`. The folder is made with the first batch."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows = last_of_batch(batch, key, "seq")
        try:
            ingest_buckets(folder, rows, key, "seq", buckets)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            create_buckets(rows, folder, key, buckets)

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
