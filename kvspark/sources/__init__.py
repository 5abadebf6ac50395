"""Bindings of tables to the model, and blob tables on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


FILE_KEYS = 25


def key_of(number: str | Column) -> Column:
    """A number as a key of eight digits, so that byte order is number order."""
    return F.lpad((F.col(number) if isinstance(number, str) else number).cast("string"), 8, "0")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a changelog: key user, seq event, an error deletes, the value is props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    return e.select(key_of("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("props").alias("value"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as key, value and the file a large value goes to; files hold ranges of FILE_KEYS keys."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", key_of("doc_id").alias("key"), F.col("text").alias("value"), (F.floor(F.col("doc_id") / FILE_KEYS) + 1).alias("file_number"))


def write_blobs(blob: DataFrame, path: str, codec: str = "zstd") -> None:
    """Records in key order in each file's partition, so that key bounds prune row groups."""
    blob.repartition("file_number").sortWithinPartitions("file_number", "key").write.partitionBy("file_number").option("compression", codec).parquet(path)


def read_blobs(spark: SparkSession, path: str, file_number: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if file_number is None else rows.filter(F.col("file_number") == file_number)
