"""The manifest: edits (edit_id, kind ADD|DELETE|NEXT_FILE, file_number) folded, checked, compacted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def replay(edits: DataFrame) -> DataFrame:
    """Files that are live after all edits: those whose last edit adds them."""
    last = edits.filter("kind <> 'NEXT_FILE'").groupBy("file_number").agg(F.max_by("kind", "edit_id").alias("kind"), F.max("edit_id").alias("edit_id"))
    return last.filter("kind = 'ADD'").select("file_number", "edit_id")


def faults(edits: DataFrame) -> DataFrame:
    """(edit_id, file_number, fault) of edits that can't be applied, each judged by the one before on its file."""
    w = Window.partitionBy("file_number").orderBy("edit_id")
    rows = edits.filter("kind <> 'NEXT_FILE'").withColumn("before", F.lag("kind").over(w))
    fault = F.when((F.col("kind") == "ADD") & (F.col("before") == "ADD"), "added twice").when((F.col("kind") == "DELETE") & F.col("before").isNull(), "unknown file").when((F.col("kind") == "DELETE") & (F.col("before") == "DELETE"), "deleted twice")
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL").select("edit_id", "file_number", "fault")


def backward_numbers(edits: DataFrame) -> DataFrame:
    """NEXT_FILE edits that go back; only these edits, one for each batch of files, are put in one order."""
    w = Window.partitionBy("kind").orderBy("edit_id")
    rows = edits.filter("kind = 'NEXT_FILE'").withColumn("before", F.lag("file_number").over(w))
    return rows.filter("file_number < before").select("edit_id", "file_number", F.lit("next file number decreases").alias("fault"))


def cancelled(edits: DataFrame) -> DataFrame:
    """Files that one edit both adds and deletes."""
    added, deleted = (edits.filter(F.col("kind") == k).select("edit_id", "file_number") for k in ("ADD", "DELETE"))
    return added.join(deleted, ["edit_id", "file_number"], "left_semi").distinct()


def dump(edits: DataFrame) -> DataFrame:
    """Files added and not deleted, then files deleted without being added."""
    added, deleted = (edits.filter(F.col("kind") == k).select("file_number").distinct() for k in ("ADD", "DELETE"))
    live = added.join(deleted, "file_number", "left_anti").withColumn("what", F.lit("live"))
    return live.unionByName(deleted.join(added, "file_number", "left_anti").withColumn("what", F.lit("deleted only")))


def snapshot(edits: DataFrame, files: DataFrame) -> DataFrame:
    """The edits that a rewritten manifest holds: one ADD for each live file that isn't obsolete."""
    live = replay(edits).join(files.filter("state <> 'OBSOLETE'").select("file_number"), "file_number", "left_semi")
    return live.select(F.lit("ADD").alias("kind"), "file_number")


def orphans(listing: DataFrame, live: DataFrame) -> DataFrame:
    """Listed files that the manifest doesn't know."""
    return listing.join(live.select("file_number"), "file_number", "left_anti")


def checkpoint(edits: DataFrame, path: str) -> None:
    """Writes the folded manifest to a new folder, as edits that replay() opens again; a folder that exists is refused."""
    replay(edits).select("edit_id", F.lit("ADD").alias("kind"), "file_number").write.mode("errorifexists").parquet(path)
