"""File metadata: live bytes, scores, histograms, selection by range, overlap, states, purging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kvspark.config import Options
from kvspark.functions import discardable_ratio, ratio_bucket

# Events of a file, the states each acts on (None: any) and the state it leads to.
TRANSITIONS = (
    ("DbStart", ("None",), "PendingInit"),
    ("DbInit", ("PendingInit",), "Normal"),
    ("FlushOrCompactionOutput", ("None",), "PendingLSM"),
    ("GCOutput", ("None",), "PendingGC"),
    ("FlushCompleted", ("PendingLSM",), "Normal"),
    ("CompactionCompleted", ("PendingLSM",), "Normal"),
    ("GCBegin", ("Normal",), "BeingGC"),
    ("GCCompleted", ("PendingGC", "BeingGC"), "Normal"),
    ("NeedMerge", ("Normal", "ToMerge"), "ToMerge"),
    ("Delete", None, "Obsolete"),
    ("Reset", None, "Normal"),
)


def fold_states(events: DataFrame) -> DataFrame:
    """The state of each file after its events (file_number, event_seq, event) in order."""
    def step(state: Column, e: Column) -> Column:
        out = state
        for event, acts_on, to in TRANSITIONS:
            hit = e["event"] == event
            out = F.when(hit & (state.isin(*acts_on) if acts_on else F.lit(True)), F.lit(to)).otherwise(out)
        return out

    ordered = F.array_sort(F.collect_list(F.struct("event_seq", "event")))
    return events.groupBy("file_number").agg(F.aggregate(ordered, F.lit("None"), step).alias("state"))


def live_bytes(pointers: DataFrame) -> DataFrame:
    """Bytes that pointers (file_number, size) reach, by file."""
    return pointers.groupBy("file_number").agg(F.sum("size").alias("live_data_size"))


def index_file_bytes(pointers: DataFrame) -> DataFrame:
    """A map file -> bytes for each index file (sst) of pointers."""
    per = pointers.groupBy("sst", "file_number").agg(F.sum("size").alias("size"))
    return per.groupBy("sst").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_number", "size")))).alias("bytes"))


def compaction_delta(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Change of live bytes by file: what outputs (file_number, size) reach less what inputs did; order plays no part."""
    signed = inputs.select("file_number", (-F.col("size")).alias("delta")).unionByName(outputs.select("file_number", F.col("size").alias("delta")))
    return signed.groupBy("file_number").agg(F.sum("delta").alias("delta"))


def compaction_completed(files: DataFrame, delta: DataFrame, seq: int, options: Options = Options()) -> DataFrame:
    """files after a compaction that changed live bytes by delta (file_number, delta).

    A file that isn't initialised only changes its bytes.  One whose flush or compaction isn't known to have ended takes
    only what is lost, as what it gained was counted when it was written, and becomes normal.  Others take the change.
    What then has no live bytes is obsolete at seq: of the second kind always, of the others under level merge, under
    which files of the last two levels beyond the discardable ratio are marked for merging.
    """
    o, state, d = options, F.col("state"), F.coalesce(F.col("delta"), F.lit(0))
    rows = files.join(delta.select(F.col("file_number").alias("f"), "delta"), F.col("file_number") == F.col("f"), "left")
    touched = F.col("f").isNotNull() & (state != "OBSOLETE")
    young, settled = touched & (state == "PENDING_LSM"), touched & state.isin("NORMAL", "TO_MERGE")
    live = F.col("live_data_size") + F.when(young, F.least(d, F.lit(0))).when(settled | (touched & (state == "PENDING_INIT")), d).otherwise(0)
    gone = (live == 0) & (young | settled & F.lit(o.level_merge))
    marked = settled & F.lit(o.level_merge) & (F.col("file_level") >= o.num_levels - 2) & (discardable_ratio(F.col("file_size"), live) > o.blob_file_discardable_ratio)
    new = F.when(gone, "OBSOLETE").when(marked, "TO_MERGE").when(young, "NORMAL").otherwise(state)
    return rows.withColumns({"live_data_size": live, "state": new, "obsolete_seq": F.when(gone, F.lit(seq).cast("long")).otherwise(F.col("obsolete_seq"))}).drop("f", "delta")


def score(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Files that aren't obsolete with ratio and score; small files score the threshold at least."""
    ratio = discardable_ratio(F.col("file_size"), F.col("live_data_size"))
    rows = files.filter("state <> 'OBSOLETE'").withColumn("ratio", ratio)
    small = F.col("file_size") < options.merge_small_file_threshold
    return rows.withColumn("score", F.when(small, F.greatest(F.lit(options.blob_file_discardable_ratio), "ratio")).otherwise(F.col("ratio")))


def ratio_histogram(files: DataFrame) -> DataFrame:
    return score(files).groupBy(ratio_bucket(F.col("ratio")).alias("bucket")).agg(F.count("*").alias("files"))


def gauges(files: DataFrame) -> DataFrame:
    """Numbers and bytes of live and obsolete files; files still to be initialised count but add no bytes."""
    live, begun = F.col("state") != "OBSOLETE", F.col("state") != "PENDING_INIT"
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return files.agg(
        F.count_if(live).alias("live_files"), F.count_if(~live).alias("obsolete_files"),
        total(live & begun, "file_size").alias("live_file_size"), total(live & begun, "live_data_size").alias("live_data_size"),
        total(~live, "file_size").alias("obsolete_file_size"),
    )


def properties(files: DataFrame, levels: int = 7) -> DataFrame:
    """(name, value): what a store says of itself by name; a name's trailing digits are a level."""
    live, begun = F.col("state") != "OBSOLETE", F.col("state") != "PENDING_INIT"
    bucket = ratio_bucket(discardable_ratio(F.col("file_size"), F.col("live_data_size")))
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    known = {
        "num-live-blob-file": F.count_if(live), "num-obsolete-blob-file": F.count_if(~live),
        "live-blob-size": total(live & begun, "live_data_size"), "live-blob-file-size": total(live & begun, "file_size"), "obsolete-blob-file-size": total(~live, "file_size"),
    }
    known |= {f"num-blob-files-at-level{k}": F.count_if(live & (F.col("file_level") == k)) for k in range(levels)}
    known |= {f"num-discardable-ratio-{b.lower()}-file": F.count_if(live & (bucket == b)) for b in ("LE0", "LE20", "LE50", "LE80", "LE100")}
    row = files.agg(F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*(v.cast("long") for v in known.values()))).alias("m"))
    return row.select(F.explode("m").alias("name", "value"))


def index_file_pairs(maps: DataFrame) -> DataFrame:
    """(sst, file_number, size) of index_file_bytes."""
    return maps.select("sst", F.explode("bytes").alias("file_number", "size"))


def files_per_level(files: DataFrame) -> DataFrame:
    return files.filter("state <> 'OBSOLETE'").groupBy("file_level").agg(F.count("*").alias("files"))


def range_condition(begin, end, include_end: bool = True) -> Column:
    """Files that lie wholly in [begin, end] or [begin, end); None is no bound."""
    cond = F.col("state").isin("NORMAL", "TO_MERGE")
    if begin is not None:
        cond &= F.col("smallest_key") >= F.lit(begin)
    if end is not None:
        cond &= F.col("smallest_key") <= F.lit(end)
        cond &= (F.col("largest_key") <= F.lit(end) if include_end else F.col("largest_key") < F.lit(end)) & (F.octet_length("largest_key") > 0)
    return cond


def delete_in_ranges(files: DataFrame, ranges: list[tuple], include_end: bool, seq: int) -> DataFrame:
    """files with those in a range obsolete at seq."""
    hit = F.lit(False)
    for begin, end in ranges:
        hit |= range_condition(begin, end, include_end)
    return files.withColumn("obsolete_seq", F.when(hit, F.lit(seq).cast("long")).otherwise(F.col("obsolete_seq"))).withColumn("state", F.when(hit, "OBSOLETE").otherwise(F.col("state")))


def purgeable(files: DataFrame, snapshots: list[int]) -> DataFrame:
    """Obsolete files that no snapshot can need: the oldest is strictly newer than the file's end."""
    oldest = min(snapshots, default=(1 << 63) - 1)
    return files.filter((F.col("state") == "OBSOLETE") & (F.lit(oldest) > F.col("obsolete_seq"))).select("file_number").distinct()


def overlap_marks(files: DataFrame, most: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """Files (file_number, smallest_key, largest_key) that are open together with more than most - 1 others.

    Ends sort before starts of one key.  A running count over each group's endpoints gives the depth; a file is marked
    if the deepest start from its own up to its end exceeds most.  The groups (levels, column families) are what runs
    in parallel; a group holds a row for each file's end, never for its records.
    """
    keep = [*groups, "file_number"]
    start = files.select(*keep, F.col("smallest_key").alias("k"), F.lit(1).alias("d"))
    end = files.select(*keep, F.col("largest_key").alias("k"), F.lit(-1).alias("d"))
    line = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    order = line.orderBy("k", "d", "file_number")
    points = start.unionByName(end).withColumn("i", F.row_number().over(order)).withColumn("depth", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    deep = points.withColumn("over", F.when((F.col("d") == 1) & (F.col("depth") > most), F.col("i")))
    # The first start that is too deep at or after the file's own one, from the last row down: Spark computes a frame that
    # ends at unboundedFollowing anew for every row.
    ahead = F.min("over").over(line.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))
    own = deep.withColumn("next", ahead)
    spans = own.groupBy(*keep).agg(F.max(F.when(F.col("d") == 1, F.col("next"))).alias("next"), F.max(F.when(F.col("d") == -1, F.col("i"))).alias("stop"))
    return spans.filter("next < stop").select(*keep)


def level_merge_candidates(files: DataFrame, target_level: int) -> DataFrame:
    return files.filter((F.col("file_level") < target_level) | (F.col("state") == "TO_MERGE"))
