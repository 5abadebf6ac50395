"""Structured Streaming: changelog ingest, running live bytes, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream of changelog rows to a Parquet table, exactly once by the checkpoint's log."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def running_versions(stream: DataFrame) -> DataFrame:
    """The newest version of each key of a stream (key, seq, op, value); for output mode update or complete."""
    return stream.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("v")).select("key", "v.*")


def running_live_bytes(deltas: DataFrame) -> DataFrame:
    """Live bytes by file out of a stream of signed deltas (file_number, delta), late ones included."""
    return deltas.groupBy("file_number").agg(F.sum("delta").alias("live_data_size"))


def windowed_writes(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Puts and deletes by window of time; rows later than the watermark are dropped."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    return rows.agg(F.count_if(F.col("op") == "PUT").alias("puts"), F.count_if(F.col("op") == "DELETE").alias("deletes")).select(F.col("w.start").alias("start"), "puts", "deletes")
