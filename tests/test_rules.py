"""Rules of the store on small made cases: picking, states, ranges, overlap, options, refusals, tables on disk, streams."""

import zlib

import pytest
from pyspark.sql import functions as F

from kvspark import functions as K
from kvspark.config import Options
from kvspark.operators import blobs, changelog as C, files, gc, manifest
from kvspark.sources import read_blobs, write_blobs
from kvspark.streaming import ingest, running_live_bytes, running_versions, windowed_writes

MIB = 1 << 20
META = "file_number long, file_size long, live_data_size long, state string, file_level int, smallest_key string, largest_key string, obsolete_seq long"


def meta(spark, rows):
    """rows: (file_number, data size, live bytes[, state])."""
    full = [(n, size + 52, live, *(more or ("NORMAL",)), 0, "a", "b", None) for n, size, live, *more in rows]
    return spark.createDataFrame(full, META)


def picked(df):
    rows = df.collect()
    return sorted(r.file_number for r in rows if r.picked), any(r.more for r in rows)


def test_pick_rounds(spark):
    left = {n: (n, 256 * MIB, 10 * MIB) for n in range(40)}
    o = Options(max_gc_batch_size=1024 * MIB, blob_file_target_size=256 * MIB)
    for k in range(10):
        hit, more = picked(gc.pick(meta(spark, left.values()), o))
        assert len(hit) == 4 and more == (k < 9)
        for n in hit:
            del left[n]


def test_pick_none_and_lone_file(spark):
    o = Options(min_gc_batch_size=0)
    assert picked(gc.pick(meta(spark, [(1, 1000, 1000)]), o)) == ([], False)
    assert picked(gc.pick(meta(spark, [(1, 1000, 1000), (2, 1000, 1000)]), o))[0] == [1, 2]
    assert picked(gc.pick(meta(spark, [(1, MIB, 0)]), Options()))[0] == []  # less than a batch
    assert picked(gc.pick(meta(spark, [(1, 900 * MIB, 0, "BEING_GC"), (2, 900 * MIB, 0)])))[0] == [2]


def test_pick_calls_for_more(spark):
    gone = [1000, 512, 512, 512]
    hit, more = picked(gc.pick(meta(spark, [(k, 1024 * MIB, (1024 - g) * MIB) for k, g in enumerate(gone)])))
    assert hit[0] == 0 and more


def test_pick_fallback_takes_dead_files_alone(spark):
    rows = [(1, 1024 * MIB, 0), (2, 1024 * MIB, 0), (3, 1024 * MIB, 512 * MIB), (4, 1024 * MIB, 512 * MIB)]
    o = Options(blob_run_mode="fallback")
    first, more = picked(gc.pick(meta(spark, rows), o))
    assert first == [1] and more
    second, more = picked(gc.pick(meta(spark, rows[1:]), o))
    assert second == [2] and not more
    assert picked(gc.pick(meta(spark, rows[2:]), o)) == ([], False)


def test_states(spark):
    cases = {1: ["DbStart", "DbInit", "GCBegin", "GCCompleted"], 2: ["FlushOrCompactionOutput", "CompactionCompleted"], 3: ["FlushOrCompactionOutput"], 4: ["GCBegin"], 5: ["GCOutput", "GCCompleted", "NeedMerge", "Delete"]}
    rows = [(f, k, e) for f, events in cases.items() for k, e in enumerate(events)]
    got = {r.file_number: r.state for r in files.fold_states(spark.createDataFrame(rows, "file_number long, event_seq long, event string")).collect()}
    assert got == {1: "Normal", 2: "Normal", 3: "PendingLSM", 4: "None", 5: "Obsolete"}


def test_compaction_completed(spark):
    rows = [(1, 100, 60, "PENDING_INIT"), (2, 100, 60, "PENDING_LSM"), (3, 100, 60, "PENDING_LSM"), (4, 100, 60), (5, 100, 60), (6, 100, 60, "OBSOLETE"), (7, 100, 60), (8, 100, 60, "PENDING_LSM")]
    df = meta(spark, rows).withColumn("file_level", F.when(F.col("file_number") == 5, 6).otherwise(1).cast("int"))
    delta = spark.createDataFrame([(1, -60), (2, 40), (3, -60), (4, -60), (5, -20), (6, -5), (8, -10)], "file_number long, delta long")
    got = lambda o: {r.file_number: (r.live_data_size, r.state) for r in files.compaction_completed(df, delta, 9, o).collect()}
    want = {1: (0, "PENDING_INIT"), 2: (60, "NORMAL"), 3: (0, "OBSOLETE"), 4: (0, "OBSOLETE"), 5: (40, "TO_MERGE"), 6: (60, "OBSOLETE"), 7: (60, "NORMAL"), 8: (50, "NORMAL")}
    assert got(Options(level_merge=True)) == want
    assert got(Options()) == want | {4: (0, "NORMAL"), 5: (40, "NORMAL")}


def test_overlap_marks(spark):
    base = ["ab", "cd", "ef", "gh", "ij", "kl"]
    mark = lambda most, more: sorted(r.file_number for r in files.overlap_marks(spark.createDataFrame([(k, *x) if isinstance(x, tuple) else (k, x[0], x[1]) for k, x in enumerate(base + more)], "file_number long, smallest_key string, largest_key string"), most).collect())
    assert mark(1, []) == []
    assert mark(1, ["ef", "gh"]) == [2, 3, 6, 7]
    assert mark(1, ["ab", "ef", "gh", "lm"]) == [0, 2, 3, 6, 7, 8]
    assert mark(2, ["cl"]) == []
    assert mark(2, ["cd", "cd"]) == [1, 6, 7]
    assert mark(2, [("b1", "d"), ("a", "d")]) == [1, 6, 7]
    assert mark(2, ["ab", "ef", "gh", "lm", ("e", "g1")]) == [2, 3, 7, 8, 10]
    assert mark(2, ["ab", "ef", "gh", "lm", ("a", "l1")]) == [0, 2, 3, 6, 7, 8, 10]


def test_overlap_marks_of_a_long_group(spark):
    import time

    n = 60_000  # one group: file k spans k to k + 2, and every hundredth has a longer one beside it
    some = spark.range(n).select(F.col("id").alias("file_number"), (F.col("id") * 10).alias("smallest_key"), (F.col("id") * 10 + 21).alias("largest_key"))
    more = spark.range(0, n, 100).select((F.col("id") + n).alias("file_number"), (F.col("id") * 10 + 5).alias("smallest_key"), (F.col("id") * 10 + 22).alias("largest_key"))
    started = time.time()
    got = {r.file_number for r in files.overlap_marks(some.unionByName(more), 3).collect()}
    assert time.time() - started < 60
    at = {k: (10 * k, 10 * k + 21) for k in range(n)} | {n + k: (10 * k + 5, 10 * k + 22) for k in range(0, n, 100)}
    near = lambda k: {j for j in range(max(0, k - 3), k + 4) if j < n} | {n + j for j in range(max(0, k - 4), k + 5) if j % 100 == 0 and j < n}
    want = set()
    for f, (a, b) in at.items():
        beside = [at[j] for j in near(f % n)]
        want |= {f for x, _ in beside if a <= x < b and sum(p <= x < q for p, q in beside) > 3}
    assert got == want and len(want) > 1000


def test_delete_in_ranges(spark):
    spans = ["00 99", "00 10", "07 55", "25 50", "25 51", "50 65", "90 99", "50 79", "70 80", "60 72", "75 91", "30 85", "50 80"]
    rows = [(k + 1, 100, 50, "NORMAL", 0, *x.split(), None) for k, x in enumerate(spans)] + [(14, 100, 50, "NORMAL", 0, "", "", None)]
    df, dead = spark.createDataFrame(rows, META), set()
    for ranges, end, new in ([("50", "80")], False, {6, 8, 10}), ([("50", "80")], True, {9, 13}), ([("", "99")], False, {2, 3, 4, 5, 11, 12}), ([(None, None)], True, {1, 7, 14}):
        df = files.delete_in_ranges(df, ranges, end, 5)
        now = {r.file_number for r in df.filter("state = 'OBSOLETE'").collect()}
        assert now - dead == new
        dead = now
    assert files.purgeable(df, [5]).count() == 0 and files.purgeable(df, [6, 9]).count() == 14


def test_routes(spark):
    rows = spark.createDataFrame([(1, "x" * 5000, False, 0, False), (2, "x", False, 0, False), (3, None, True, 2, False), (4, None, True, 6, False), (5, None, True, 6, True)], "id long, v string, p boolean, level int, merge boolean")
    way = lambda o, **k: [r.w for r in rows.orderBy("id").select(blobs.route(F.col("v"), F.col("p"), o, **k).alias("w")).collect()]
    assert way(Options()) == ["separate", "inline", "pass", "pass", "pass"]
    assert way(Options(blob_run_mode="fallback")) == ["pass", "pass", "dereference", "dereference", "dereference"]
    assert way(Options(level_merge=True), target_level=6, file_level=F.col("level"), to_merge=F.col("merge")) == ["separate", "inline", "relocate", "pass", "relocate"]


def test_strict_dereference_fails(spark):
    index = spark.createDataFrame([("k", None, (1, 20, 30))], "key string, inline_value string, pointer struct<file_number:long,offset:long,size:long>")
    blob = spark.createDataFrame([], "file_number long, offset long, size long, key string, value string")
    assert blobs.dereference(index, blob, strict=False).collect() == [("k", None, "Corruption")]
    with pytest.raises(Exception, match="Corruption"):
        blobs.dereference(index, blob).collect()


def test_conflicts_by_other_blob_and_install(spark):
    pointer = "pointer struct<file_number:long,offset:long,size:long>"
    then = spark.createDataFrame([("a", (1, 20, 30)), ("b", (1, 50, 30)), ("c", (1, 80, 30))], f"key string, {pointer}")
    now = spark.createDataFrame([("a", None, (1, 20, 30)), ("b", None, (2, 20, 30)), ("d", "in", None)], f"key string, inline_value string, {pointer}")
    blob = spark.createDataFrame([(1, 20 + 30 * k, 30, x, "v" * 18) for k, x in enumerate("abc")], "file_number long, offset long, size long, key string, value string")
    assert sorted((r.key, r.reason) for r in gc.conflicts(blob, now).collect()) == [("b", "key overwritten with other blob"), ("c", "key deleted")]
    moved = gc.relocate(blob, then, F.col("file_number") == 1, F.lit(9))
    assert sorted((r.key, r.new_offset) for r in moved.collect()) == [("a", 20), ("b", 50), ("c", 80)]
    got = {r.key: (r.pointer.file_number, r.pointer.offset) if r.pointer else None for r in gc.install(moved, now).collect()}
    assert got == {"a": (9, 20), "b": (2, 20), "d": None}
    assert gc.dropped_bytes(moved, now).collect() == [(9, 60)]


def test_options():
    o = Options()
    assert (o.min_blob_size, o.max_gc_batch_size, o.blob_file_discardable_ratio, o.blob_run_mode, o.max_sorted_runs) == (4096, 1 << 30, 0.5, "normal", 20)
    new = o.set_options(min_blob_size="123", blob_run_mode="fallback", blob_file_discardable_ratio="0.25")
    assert (new.min_blob_size, new.blob_run_mode, new.blob_file_discardable_ratio) == (123, "fallback", 0.25) and o.min_blob_size == 4096
    for bad in ({"blob_run_mode": "odd"}, {"num_levels": 3}, {"blob_file_compression": "odd"}, {"blob_file_discardable_ratio": "1.5"}):
        with pytest.raises(ValueError):
            o.set_options(**bad)
    with pytest.raises(ValueError):
        Options(level_merge=True, dynamic_level_bytes=False)


def test_merge_and_single_delete_are_refused():
    for f in (C.merge, C.single_delete):
        with pytest.raises(NotImplementedError):
            f()


def test_checksum_is_crc32(spark):
    rows = [("",), ("abc",), ("é" * 999,)]
    assert all(r.crc == zlib.crc32(r.v.encode()) for r in spark.createDataFrame(rows, "v string").select("v", F.crc32("v").alias("crc")).collect())


def test_next_file_number_and_checkpoint(spark, tmp_path):
    edits = spark.createDataFrame([(1, "NEXT_FILE", 5), (2, "ADD", 4), (3, "NEXT_FILE", 9), (4, "NEXT_FILE", 7), (5, "DELETE", 4), (6, "ADD", 8)], "edit_id long, kind string, file_number long")
    assert [r.edit_id for r in manifest.backward_numbers(edits).collect()] == [4]
    path = f"file://{tmp_path}/checkpoint"
    manifest.checkpoint(edits, path)
    assert [r.file_number for r in manifest.replay(spark.read.parquet(path)).collect()] == [8]
    with pytest.raises(Exception, match="exist"):
        manifest.checkpoint(edits, path)


def test_compact_range_and_snapshots(spark):
    log = spark.createDataFrame([("a", 1, "PUT", "1"), ("a", 3, "PUT", "3"), ("b", 2, "PUT", "2"), ("b", 4, "DELETE", None), ("c", 5, "PUT", "5"), ("c", 6, "PUT", "6")], "key string, seq long, op string, value string")
    assert sorted(C.compact_range(log, None, "c").select("key", "seq").collect()) == [("a", 3), ("c", 5), ("c", 6)]
    assert sorted(map(tuple, C.snapshots(log, [1, 2, 5]).select("snap", "key", "value").collect())) == [(1, "a", "1"), (2, "a", "1"), (2, "b", "2"), (5, "a", "3"), (5, "c", "5")]


def test_blobs_on_disk_and_padding(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, f"{k:03}", "v" * k) for k in range(30)], "file_number long, key string, value string")
    write_blobs(blobs.offsets(rows), f"file://{tmp_path}/blobs")
    back = read_blobs(spark, f"file://{tmp_path}/blobs", 1)
    assert sorted(r.key for r in back.collect()) == [f"{k:03}" for k in range(30) if k % 3 == 1]
    assert "PartitionFilters: [isnotnull(file_number" in back._jdf.queryExecution().toString()
    size = lambda n: spark.range(1).select(K.padded_size(F.lit(n), 4096)).first()[0]
    assert (size(4096), size(4097), size(1)) == (4096, 8192, 4096)


def test_streams(spark, tmp_path):
    rows = [("a", 1, "PUT", "1"), ("a", 2, "PUT", "2"), ("b", 3, "DELETE", None)]
    spark.createDataFrame(rows, "key string, seq long, op string, value string").withColumn("at", F.timestamp_seconds(F.col("seq") * 4000)).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("key string, seq long, op string, value string, at timestamp").parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        ingest(stream(), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(running_versions(stream()), "versions") == [("a", 2, "PUT", "2"), ("b", 3, "DELETE", None)]
    assert run(running_live_bytes(stream().select(F.length("key").cast("long").alias("file_number"), F.col("seq").alias("delta"))), "live") == [(1, 6)]
    assert [r[1:] for r in run(windowed_writes(stream(), "at"), "windows")] == [(1, 0), (1, 0), (0, 1)]
