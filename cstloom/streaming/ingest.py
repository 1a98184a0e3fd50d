"""Incremental ingest: new chunk files are embedded and appended as they arrive.

An extension beside the batch load, which replaces a collection.  Exactly once
per file through the checkpoint of the stream; a batch that runs again first
drops the rows of its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cstloom.operators import collection


def ingest(spark: SparkSession, inbox: str, folder: str, model: str, checkpoint: str, schema, embedder=collection.hashing_embedder, available_now: bool = True) -> StreamingQuery:
    """Start a stream from a folder of Parquet chunk files into a model's collection."""
    arrived = spark.readStream.schema(schema).parquet(inbox)

    def append(batch: DataFrame, number: int) -> None:
        good, _ = collection.split_rejects(collection.prepare(batch.dropDuplicates(["id"]), embedder))
        collection.write(good, folder, model, batch=number)

    writer = arrived.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def event_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Windowed counts of an event stream with a watermark (window_start, event_type, n)."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n")
