"""Garbage collection of blob files: picking, telling live records from dead ones, rewriting, conflicts, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kvspark.config import Options
from kvspark.operators.blobs import offsets
from kvspark.operators.files import score


def pick(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Scored files with picked, and whether what remains calls for another round (more).

    By falling score, a file is picked while the files before it hold less than a batch and their live bytes less than
    a target file.  Nothing is picked if what is picked is small in both, or is one small file under the threshold.
    The window runs over candidate files, which the score's threshold has cut, not over records.
    """
    o = options
    rows = score(files, o).filter(F.col("score") >= o.blob_file_discardable_ratio).filter("state = 'NORMAL'")
    if o.blob_run_mode == "fallback":
        rows = rows.filter(F.abs(1 - F.col("score")) <= 1e-9)
    before = Window.orderBy(F.col("score").desc(), "file_number").rowsBetween(Window.unboundedPreceding, -1)
    held = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumn("picked", (held("file_size") < o.max_gc_batch_size) & (held("live_data_size") < o.blob_file_target_size))
    every = Window.partitionBy(F.lit(0))
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))).over(every), F.lit(0))
    n, size, live = F.count_if("picked").over(every), total(F.col("picked"), "file_size"), total(F.col("picked"), "live_data_size")
    lone = (n == 1) & (F.max(F.when(F.col("picked"), F.col("file_size"))).over(every) <= o.merge_small_file_threshold) & (F.max(F.when(F.col("picked"), F.col("ratio"))).over(every) < o.blob_file_discardable_ratio)
    none = F.lit(False) if o.blob_run_mode == "fallback" else ((size < o.min_gc_batch_size) & (live < o.blob_file_target_size)) | lone
    left = F.count_if(~F.col("picked")).over(every) > 0 if o.blob_run_mode == "fallback" else total(~F.col("picked"), "file_size") > o.min_gc_batch_size
    return rows.withColumn("none", none).withColumn("more", left & ~none).withColumn("picked", F.col("picked") & ~F.col("none")).drop("none")


def _pointer_is(current: str = "pointer") -> Column:
    return (F.col(f"{current}.file_number") == F.col("file_number")) & (F.col(f"{current}.offset") == F.col("offset"))


def live_records(blob: DataFrame, index: DataFrame) -> DataFrame:
    """Records that the current index entry of their key points to."""
    now = index.select("key", "pointer").filter("pointer IS NOT NULL")
    return blob.join(now.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & _pointer_is(), "left_semi")


def dead_records(blob: DataFrame, index: DataFrame) -> DataFrame:
    now = index.select("key", "pointer").filter("pointer IS NOT NULL")
    return blob.join(now.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & _pointer_is(), "left_anti")


def conflicts(planned: DataFrame, index: DataFrame) -> DataFrame:
    """planned records (key, file_number, offset, size) that changed since, and how."""
    now = index.select(F.col("key").alias("k"), "pointer", F.lit(True).alias("there"))
    reason = F.when(F.col("there").isNull(), "key deleted").when(F.col("pointer").isNull(), "key overwritten with other value").when(~_pointer_is(), "key overwritten with other blob")
    rows = planned.join(now, F.col("key") == F.col("k"), "left").withColumn("reason", reason)
    return rows.filter("reason IS NOT NULL").select("key", "file_number", "size", "reason")


def relocate(blob: DataFrame, index: DataFrame, inputs: Column, to: Column) -> DataFrame:
    """Records of the input files that index points to when a collection begins, laid out in new files.

    blob (file_number, offset, key, value, size) with new_file and new_offset; to is the new file of a record and must
    grow with the key, a file holding no more than the target size.
    """
    now = live_records(blob.filter(inputs), index).withColumn("new_file", to)
    laid = offsets(now.select(F.col("new_file").alias("file_number"), "key", "value")).select(F.col("file_number").alias("new_file"), "key", F.col("offset").alias("new_offset"))
    return now.join(laid, ["new_file", "key"])


def install(moved: DataFrame, index: DataFrame) -> DataFrame:
    """index (key, inline_value, pointer) as a collection leaves it: a key gets its new pointer if the one that its record
    was moved from is still there; an entry that has changed in the meantime stays."""
    to = moved.select(F.col("key").alias("k"), F.struct("file_number", "offset").alias("was"), F.struct(F.col("new_file").alias("file_number"), F.col("new_offset").alias("offset"), "size").alias("now"))
    rows = index.join(to, F.col("key") == F.col("k"), "left")
    kept = (F.col("was.file_number") == F.col("pointer.file_number")) & (F.col("was.offset") == F.col("pointer.offset"))
    return rows.select("key", "inline_value", F.when(kept, F.col("now")).otherwise(F.col("pointer")).alias("pointer"))


def dropped_bytes(moved: DataFrame, index: DataFrame) -> DataFrame:
    """Bytes of new files that a collection has written for keys which have changed in the meantime, by file."""
    lost = conflicts(moved.select("key", "file_number", "offset", "size"), index).select("key")
    return moved.join(lost, "key", "left_semi").groupBy(F.col("new_file").alias("file_number")).agg(F.sum("size").alias("dropped"))


def finish(files: DataFrame, inputs: Column, seq: int) -> DataFrame:
    """files with the inputs of a collection obsolete at seq; those that were so before keep their number."""
    hit = inputs & (F.col("state") != "OBSOLETE")
    return files.withColumns({"obsolete_seq": F.when(hit, F.lit(seq).cast("long")).otherwise(F.col("obsolete_seq")), "state": F.when(hit, "OBSOLETE").otherwise(F.col("state"))})


def metrics(blob: DataFrame, index: DataFrame) -> DataFrame:
    """Records and bytes that a collection reads, relocates and drops."""
    now = index.filter("pointer IS NOT NULL").select(F.col("key").alias("k"), "pointer")
    rows = blob.join(now, F.col("key") == F.col("k"), "left").withColumn("live", F.coalesce(_pointer_is(), F.lit(False)))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0))
    return rows.agg(
        F.count("*").alias("keys_read"), F.sum("size").alias("bytes_read"), F.count_if("live").alias("keys_relocated"), total(F.col("live")).alias("bytes_relocated"),
        F.count_if(~F.col("live")).alias("keys_overwritten"), total(~F.col("live")).alias("bytes_overwritten"), F.count_distinct("file_number").alias("files_in"),
    )
