"""Keeping a manifest table up to date from a stream of manifest rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from linkloom.operators import manifest
from linkloom.sources.store import ManifestStore


def ingest(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream to its end now, adding each batch's rows to the folder.

    A batch is written under the stream's own name and the batch's number, so one that is run again after a failure takes its own
    place, and streams with other checkpoints add to the same manifest.  Only the batch is written, whatever the manifest's size.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def put(batch: DataFrame, number: int) -> None:
        manifest.lenient(batch).write.mode("overwrite").parquet(f"{folder}/stream={stream}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(changes: DataFrame, store: ManifestStore, checkpoint: str) -> StreamingQuery:
    """Runs the stream to its end now, merging each batch into the store once, also if it is run again after a failure.

    Several streams, with other checkpoints, may merge into one store.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def put(batch: DataFrame, number: int) -> None:
        store.merge(batch, once=(stream, number))

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest: of several rows of a URL the last fetched, then that of the latest batch."""
    schema = spark.createDataFrame([], manifest.SCHEMA).schema.add("stream", "string").add("batch", "long")
    rows = spark.read.schema(schema).parquet(folder)
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("batch"), "stream")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "stream", "batch")


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """Writes the manifest's rows, one for each URL, to another folder that ingest can go on with."""
    latest(spark, folder).write.parquet(f"{into}/stream=compacted/batch=0")
