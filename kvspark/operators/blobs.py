"""Separated values: routing by size, pointers, dereferencing, layout of records in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kvspark.config import Options
from kvspark.functions import FILE_HEADER, record_size


def route(value: Column, is_pointer: Column, options: Options = Options(), target_level: int = 0, file_level: Column | None = None, to_merge: Column | None = None) -> Column:
    """What a rewrite does with an entry: inline, separate, dereference, relocate or pass."""
    deep = options.level_merge and target_level >= max(1, options.num_levels - 2)
    move = F.lit(False)
    if options.blob_run_mode == "normal" and deep:
        move = (F.coalesce(file_level, F.lit(0)) < target_level) | F.coalesce(to_merge, F.lit(False))
    mode = F.lit(options.blob_run_mode)
    small = F.octet_length(value) < options.min_blob_size
    return (
        F.when(is_pointer & (mode == "fallback"), "dereference")
        .when(is_pointer & move, "relocate")
        .when(is_pointer | (mode != "normal"), "pass")
        .when(small, "inline")
        .otherwise("separate")
    )


def separate(rows: DataFrame, file_number: Column, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(index, blob) of rows (key, value): large values go to files and leave a pointer (file_number, offset, size)."""
    way = route(F.col("value"), F.lit(False), options)
    routed = rows.withColumn("way", way).withColumn("file_number", F.when(F.col("way") == "separate", file_number))
    blob = offsets(routed.filter("way = 'separate'").select("file_number", "key", "value"))
    pointer = F.struct("file_number", "offset", "size").alias("pointer")
    inline = routed.filter("way <> 'separate'").select("key", F.col("value").alias("inline_value"), F.lit(None).cast("struct<file_number:bigint,offset:bigint,size:bigint>").alias("pointer"))
    return inline.unionByName(blob.select("key", F.lit(None).cast("string").alias("inline_value"), pointer)), blob


def offsets(records: DataFrame, padding: int = 0) -> DataFrame:
    """records (file_number, key, value) with size and byte offset, in key order after the file's header.

    A file is bounded by its target size, so a window over one is, too.
    """
    w = Window.partitionBy("file_number").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    sized = records.withColumn("size", record_size(F.col("key"), F.col("value")))
    step = F.ceil(F.col("size") / padding) * padding if padding else F.col("size")
    return sized.withColumn("offset", (F.lit(FILE_HEADER) + F.coalesce(F.sum(step).over(w), F.lit(0))).cast("long"))


def dereference(index: DataFrame, blob: DataFrame, strict: bool = True) -> DataFrame:
    """index (key, inline_value, pointer) with value and status; only rows with a pointer meet the blob table.

    A missing record or one of another size is corrupt: strict, the query fails; else the value is null.
    """
    records = blob.select(F.col("file_number").alias("f"), F.col("offset").alias("o"), F.col("size").alias("s"), F.col("value").alias("v"))
    on = (F.col("pointer.file_number") == F.col("f")) & (F.col("pointer.offset") == F.col("o"))
    joined = index.filter("pointer IS NOT NULL").join(records, on, "left")
    good = F.col("s").isNotNull() & (F.col("s") == F.col("pointer.size"))
    bad = F.raise_error(F.concat(F.lit("Corruption: no record for key "), F.col("key").cast("string"))).cast("string") if strict else F.lit("Corruption")
    status = F.when(good, F.lit("OK")).otherwise(bad)
    found = joined.select("key", F.when(good, F.col("v")).alias("value"), status.alias("status"))
    return index.filter("pointer IS NULL").select("key", F.col("inline_value").alias("value"), F.lit("OK").alias("status")).unionByName(found)


def roll_over(records: DataFrame, target: int) -> DataFrame:
    """records (part, key, size) with the file each goes to: a file ends with the record that fills it to target.

    Parts are ranges of the key order, of a bounded number of records each; in a part, a fold over the ordered sizes
    carries the bytes since the last end, which no window function can.
    """
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        held, number, out = FILE_HEADER, 0, []
        for size in part["size"]:
            out.append(number)
            held += size
            if held >= target:
                held, number = FILE_HEADER, number + 1
        return part.assign(file=out)

    kinds = records.select("part", "key", "size").schema
    return records.select("part", "key", "size").groupBy("part").applyInPandas(run, kinds.add("file", "long"))


def file_meta(blob: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Per file: entries, size, smallest and largest key, and the bytes of records in live (file_number, offset)."""
    rows = blob.withColumn("live", F.lit(True))
    if live is not None:
        rows = blob.join(live.select("file_number", "offset", F.lit(True).alias("live")), ["file_number", "offset"], "left")
    return rows.groupBy("file_number").agg(
        F.count("*").alias("file_entries"),
        (F.sum("size") + 52).alias("file_size"),
        F.min("key").alias("smallest_key"),
        F.max("key").alias("largest_key"),
        F.coalesce(F.sum(F.when(F.col("live"), F.col("size"))), F.lit(0)).alias("live_data_size"),
    )


def sequential(reads: DataFrame) -> DataFrame:
    """reads (file_number, pos, offset, size) with whether each begins where the one before it in its file ended."""
    w = Window.partitionBy("file_number").orderBy("pos")
    return reads.withColumn("sequential", F.coalesce(F.lag(F.col("offset") + F.col("size")).over(w) == F.col("offset"), F.lit(False)))
