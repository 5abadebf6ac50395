"""Queries of the store's operators over the events, documents, orders and other tables, with equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kvspark import functions as K
from kvspark.config import Options
from kvspark.operators import blobs, changelog as C, files, gc, manifest
from kvspark.sources import document_rows, events_log, key_of

SNAP = 5000
LOW, HIGH = "00000020", "00000090"
OPTIONS = Options(min_gc_batch_size=0, max_gc_batch_size=1 << 20, blob_file_target_size=1 << 18, merge_small_file_threshold=0, blob_file_discardable_ratio=0.05)

# Named parts of the SQL.
LOG = "log AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, props AS value FROM events)"


def newest(where: str = "TRUE", log: str = "log", name: str = "latest") -> str:
    return f"{name} AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {log} WHERE {where}) WHERE rn = 1 AND op = 'PUT')"


LATEST = f"WITH {LOG}, {newest()} "
VARLEN = "CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 WHEN n < 268435456 THEN 4 ELSE 5 END"
RECORDS = f"rec AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS key, text AS value, doc_id // 25 + 1 AS file_number, 18 + n + {VARLEN} AS size FROM (SELECT *, CAST(strlen(text) AS BIGINT) AS n FROM documents) WHERE n >= 4096), blob AS (SELECT *, CAST(20 + coalesce(sum(size) OVER (PARTITION BY file_number ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM rec)"
INDEX = "lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id), state AS (SELECT b.*, CASE WHEN quality = 0 THEN 'key deleted' WHEN toxic = 1 THEN 'key overwritten with other value' END AS reason FROM blob b LEFT JOIN lab USING (doc_id))"
FILES = "files AS (SELECT file_number, count(*) AS file_entries, CAST(52 + sum(size) AS BIGINT) AS file_size, min(key) AS smallest_key, max(key) AS largest_key, CAST(coalesce(sum(size) FILTER (reason IS NULL), 0) AS BIGINT) AS live_data_size, CAST(file_number % 7 AS INT) AS file_level, CASE WHEN file_number % 11 = 0 THEN 'OBSOLETE' WHEN file_number % 7 = 3 THEN 'BEING_GC' ELSE 'NORMAL' END AS state, CASE WHEN file_number % 11 = 0 THEN file_number * 10 END AS obsolete_seq FROM state GROUP BY file_number)"
META = f"WITH {RECORDS}, {INDEX}, {FILES} "
RATIO = "CASE WHEN file_size = 0 THEN 0 ELSE 1 - live_data_size / nullif(CAST(file_size - 52 AS DOUBLE), 0) END"
EDITS = "WITH edits AS (SELECT o_orderkey AS edit_id, CASE o_orderstatus WHEN 'F' THEN 'DELETE' WHEN 'O' THEN 'ADD' ELSE 'NEXT_FILE' END AS kind, o_custkey AS file_number FROM orders) "


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def large_rows(s: SparkSession, d: str) -> DataFrame:
    return document_rows(s, d).filter(F.octet_length("value") >= 4096)


def blob_table(s: SparkSession, d: str) -> DataFrame:
    return blobs.offsets(large_rows(s, d))


def not_deleted(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """rows less documents of low quality, with whether they are toxic."""
    lab = read(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return rows.join(lab, "doc_id", "left").filter("coalesce(quality, 1) <> 0")


def index_table(s: SparkSession, d: str, blob: DataFrame | None = None) -> DataFrame:
    """Pointers of the large documents, less those of low quality (deleted); toxic ones are inline by now."""
    rows = not_deleted(s, d, blob_table(s, d) if blob is None else blob)
    inline = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    return rows.select("key", F.when(inline, "overwritten").alias("inline_value"), F.when(~inline, F.struct("file_number", "offset", "size")).alias("pointer"))


def file_table(s: SparkSession, d: str) -> DataFrame:
    live = gc.live_records(blob_table(s, d), index_table(s, d)).select("file_number", "offset")
    n = F.col("file_number")
    state = F.when(n % 11 == 0, "OBSOLETE").when(n % 7 == 3, "BEING_GC").otherwise("NORMAL")
    return blobs.file_meta(blob_table(s, d), live).withColumns({"file_level": (n % 7).cast("int"), "state": state, "obsolete_seq": F.when(n % 11 == 0, n * 10)})


def edit_table(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "DELETE").when(F.col("o_orderstatus") == "O", "ADD").otherwise("NEXT_FILE")
    return read(s, d, "orders").select(F.col("o_orderkey").alias("edit_id"), kind.alias("kind"), F.col("o_custkey").alias("file_number"))


def requests(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select(F.col("c_custkey").alias("pos"), key_of("c_custkey").alias("key"))


def interval_table(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").groupBy(F.col("o_custkey").alias("file_number")).agg(F.min("o_orderkey").alias("smallest_key"), F.max("o_orderkey").alias("largest_key"))
    return o.withColumn("level", F.col("file_number") % 50)


def state_events(s: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("FlushOrCompactionOutput", "CompactionCompleted", "GCBegin", "GCCompleted", "NeedMerge"))), (F.col("event_id") % 5 + 1).cast("int"))
    return read(s, d, "events").select(F.col("user_id").alias("file_number"), F.col("event_id").alias("event_seq"), name.alias("event"))


def pairs_of(s: SparkSession, d: str, before: bool) -> DataFrame:
    """Pointers that a compaction read (lines still open) or wrote (all others)."""
    line = read(s, d, "lineitem").filter("l_linestatus = 'O'" if before else "l_linestatus <> 'O'")
    return pointers(line)


def pointers(line: DataFrame) -> DataFrame:
    return line.select(F.col("l_suppkey").alias("file_number"), F.col("l_partkey").alias("size"), F.col("l_orderkey").alias("sst"))


Q: dict[str, tuple] = {}


def query(sql: str | None):
    def register(f):
        Q[f.__name__] = (f, sql)
        return f

    return register


KSV = ("key", "seq", "value")


@query(f"WITH {LOG}, {newest(f'seq <= {SNAP}')} SELECT key, seq, value FROM latest")
def snapshot_read(s, d):
    return C.latest(events_log(s, d), SNAP).select(*KSV)


@query(LATEST + "SELECT key, seq, value FROM latest")
def latest_version(s, d):
    return C.latest(events_log(s, d)).select(*KSV)


@query(LATEST + "SELECT key, seq, value FROM latest WHERE key = '00000042'")
def point_get(s, d):
    return C.point_get(events_log(s, d), "00000042").select(*KSV)


@query(LATEST + ", q AS (SELECT c_custkey AS pos, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer) SELECT pos, q.key, value, CASE WHEN l.key IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM q LEFT JOIN latest l ON l.key = q.key")
def multi_get(s, d):
    return C.multi_get(events_log(s, d), requests(s, d))


@query(LATEST + "SELECT key, value FROM latest ORDER BY key")
def scan_forward(s, d):
    return C.scan(events_log(s, d)).select("key", "value")


@query(LATEST + "SELECT key, value FROM latest ORDER BY key DESC")
def scan_reverse(s, d):
    return C.scan(events_log(s, d), reverse=True).select("key", "value")


@query(LATEST + f"SELECT key, value FROM latest WHERE key >= '{LOW}' ORDER BY key LIMIT 10")
def seek_ge(s, d):
    return C.seek(events_log(s, d), LOW, 10).select("key", "value")


@query(LATEST + f"SELECT key, value FROM latest WHERE key <= '{HIGH}' ORDER BY key DESC LIMIT 1")
def seek_for_prev(s, d):
    return C.seek_for_prev(events_log(s, d), HIGH).select("key", "value")


@query(LATEST + f"SELECT key, value FROM latest WHERE key >= '{LOW}' AND key < '{HIGH}'")
def range_scan(s, d):
    return C.scan(events_log(s, d), lower=LOW, upper=HIGH, sort=False).select("key", "value")


@query(LATEST + "SELECT key, value FROM latest WHERE key LIKE '0000001%'")
def prefix_scan(s, d):
    return C.scan(events_log(s, d), prefix="0000001", sort=False).select("key", "value")


@query(LATEST + "SELECT key FROM latest")
def key_only_scan(s, d):
    return C.scan(events_log(s, d), key_only=True, sort=False).select("key")


@query(f"WITH {LOG}, a AS (SELECT 'users' AS cf, * FROM log WHERE seq <= {SNAP}), b AS (SELECT 'shards' AS cf, lpad(CAST(CAST(key AS BIGINT) % 16 AS VARCHAR), 8, '0') AS key, seq, op, value FROM log WHERE seq <= {SNAP}), r AS (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT cf, key, seq, value FROM r WHERE rn = 1 AND op = 'PUT'")
def multi_cf_scan(s, d):
    log = events_log(s, d)
    other = log.withColumn("key", key_of(F.col("key").cast("long") % 16))
    both = log.withColumn("cf", F.lit("users")).unionByName(other.withColumn("cf", F.lit("shards")))
    return C.latest(both, SNAP, ("cf", "key")).select("cf", *KSV)


@query(f"WITH {LOG}, snaps AS (SELECT unnest([1000, 3000, 5000, 9000]) AS snap), r AS (SELECT snap, log.*, row_number() OVER (PARTITION BY snap, key ORDER BY seq DESC) AS rn FROM log JOIN snaps ON seq <= snap) SELECT CAST(snap AS BIGINT) AS snap, key, seq, value FROM r WHERE rn = 1 AND op = 'PUT'")
def asof_multi_snapshot(s, d):
    return C.snapshots(events_log(s, d), [1000, 3000, 5000, 9000]).withColumn("snap", F.col("snap").cast("long"))


@query(f"WITH {LOG}, t AS (SELECT max(seq) AS top FROM log), l2 AS (SELECT * FROM log UNION ALL SELECT lpad(CAST(n_nationkey AS VARCHAR), 8, '0'), top + n_nationkey + 1, 'PUT', n_name FROM nation, t), {newest(log='l2')} SELECT key, seq, value FROM latest")
def apply_puts(s, d):
    batch = read(s, d, "nation").select(key_of("n_nationkey").alias("key"), F.lit("PUT").alias("op"), F.col("n_name").alias("value"), (F.col("n_nationkey") + 1).alias("pos"))
    return C.latest(C.write_batch(events_log(s, d), batch)).select(*KSV)


@query(f"WITH {LOG}, t AS (SELECT max(seq) AS top FROM log), l2 AS (SELECT * FROM log UNION ALL SELECT lpad(CAST(n_nationkey AS VARCHAR), 8, '0'), top + n_nationkey + 1, 'DELETE', NULL FROM nation, t), {newest(log='l2')} SELECT key, seq, value FROM latest")
def apply_deletes(s, d):
    batch = read(s, d, "nation").select(key_of("n_nationkey").alias("key"), F.lit("DELETE").alias("op"), F.lit(None).cast("string").alias("value"), (F.col("n_nationkey") + 1).alias("pos"))
    return C.latest(C.write_batch(events_log(s, d), batch)).select(*KSV)


@query(f"WITH {LOG}, t AS (SELECT max(seq) AS top FROM log), m AS (SELECT max(n_nationkey) + 1 AS k FROM nation), l2 AS (SELECT * FROM log UNION ALL SELECT lpad(CAST(n_nationkey AS VARCHAR), 8, '0'), top + n_nationkey + 1, 'PUT', n_name FROM nation, t UNION ALL SELECT lpad(CAST(r_regionkey AS VARCHAR), 8, '0'), top + k + r_regionkey + 1, 'DELETE', NULL FROM region, t, m), {newest(log='l2')} SELECT key, seq, value FROM latest")
def write_batch(s, d):
    puts = read(s, d, "nation").select(key_of("n_nationkey").alias("key"), F.lit("PUT").alias("op"), F.col("n_name").alias("value"), (F.col("n_nationkey") + 1).alias("pos"))
    drops = read(s, d, "region").select(key_of("r_regionkey").alias("key"), F.lit("DELETE").alias("op"), F.lit(None).cast("string").alias("value"), (F.col("r_regionkey") + 1).alias("pos"))
    return C.latest(C.write_batch(events_log(s, d), puts, drops)).select(*KSV)


@query(f"WITH {LOG}, l2 AS (SELECT * FROM log UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0'), (SELECT max(seq) + 1 FROM log), 'PUT', s_name FROM supplier), {newest(log='l2')} SELECT key, seq, value FROM latest")
def bulk_ingest(s, d):
    rows = read(s, d, "supplier").select(key_of("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    return C.latest(C.ingest(events_log(s, d), rows)).select(*KSV)


@query(f"WITH {LOG}, l2 AS (SELECT * FROM log WHERE NOT (key >= '{LOW}' AND key < '{HIGH}' AND seq < 9000)), {newest(log='l2')} SELECT key, seq, value FROM latest")
def delete_range(s, d):
    return C.latest(C.delete_range(events_log(s, d), [(LOW, HIGH, 9000)])).select(*KSV)


@query(LATEST + "SELECT key, seq, value FROM latest WHERE NOT coalesce(strlen(value) % 2 = 0, FALSE)")
def compaction_filter(s, d):
    return C.compaction_filter(events_log(s, d), F.octet_length("value") % 2 == 0).select(*KSV)


@query(LATEST + "SELECT key, seq FROM latest WHERE NOT key LIKE '%7'")
def compaction_filter_keyonly(s, d):
    return C.compaction_filter(events_log(s, d).drop("value"), F.col("key").endswith("7")).select("key", "seq")


@query(LATEST + "SELECT key, seq, value FROM latest WHERE NOT (SELECT max(seq) FROM log) - seq > 100")
def ttl_expire(s, d):
    log = events_log(s, d)
    return C.expire(log, F.col("seq"), log.agg(F.max("seq")).scalar(), 100).select(*KSV)


@query(f"WITH {LOG}, {newest(f"key >= '{LOW}' AND key < '{HIGH}'")} SELECT key, seq, op, value FROM log WHERE NOT (key >= '{LOW}' AND key < '{HIGH}') UNION ALL SELECT key, seq, 'PUT', value FROM latest")
def compact_range(s, d):
    return C.compact_range(events_log(s, d), LOW, HIGH).select("key", "seq", "op", "value")


@query(LATEST + "SELECT key, value FROM latest WHERE reverse(key) >= '5' ORDER BY reverse(key) LIMIT 25")
def scan_own_order(s, d):
    return C.scan(events_log(s, d), lower="5", limit=25, order_key=F.reverse("key")).select("key", "value")


@query(LATEST + "SELECT count(*) AS entries, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes FROM latest")
def compact_all(s, d):
    return C.latest(events_log(s, d)).agg(F.count("*").alias("entries"), F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("bytes"))


@query(f"WITH {LOG} SELECT key, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS value FROM log GROUP BY key")
def append_fold(s, d):
    return C.fold_append(events_log(s, d).withColumn("value", F.col("seq").cast("string")))


@query("SELECT user_id, CAST(bit_xor(event_id) AS BIGINT) AS folded FROM events GROUP BY user_id")
def xor_fold(s, d):
    return read(s, d, "events").groupBy("user_id").agg(F.bit_xor("event_id").alias("folded"))


# Separated values.


@query("SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS key, strlen(text) >= 4096 AS separated, CASE WHEN strlen(text) < 4096 THEN text END AS inline_value FROM documents")
def kv_separation(s, d):
    index, _ = blobs.separate(document_rows(s, d).select("key", "value", "file_number"), F.col("file_number"))
    return index.select("key", F.col("pointer").isNotNull().alias("separated"), "inline_value")


@query("WITH m AS (SELECT unnest(['normal', 'read_only', 'fallback']) AS mode) SELECT mode, way, count(*) AS n FROM (SELECT mode, CASE WHEN doc_id % 5 = 0 AND mode = 'fallback' THEN 'dereference' WHEN doc_id % 5 = 0 OR mode <> 'normal' THEN 'pass' WHEN strlen(text) < 4096 THEN 'inline' ELSE 'separate' END AS way FROM documents, m) GROUP BY mode, way")
def run_mode_routing(s, d):
    rows, out = document_rows(s, d), None
    for mode in ("normal", "read_only", "fallback"):
        way = blobs.route(F.col("value"), F.col("doc_id") % 5 == 0, Options(blob_run_mode=mode))
        part = rows.groupBy(way.alias("way")).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "way", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {RECORDS} SELECT key, size FROM blob")
def record_size(s, d):
    return document_rows(s, d).filter(F.octet_length("value") >= 4096).select("key", K.record_size(F.col("key"), F.col("value")).alias("size"))


@query(f"WITH {RECORDS} SELECT key, CAST(ceil(size / 4096.0) * 4096 AS BIGINT) AS padded FROM blob")
def padded_size(s, d):
    return document_rows(s, d).filter(F.octet_length("value") >= 4096).select("key", K.padded_size(K.record_size(F.col("key"), F.col("value")), 4096).alias("padded"))


@query(f'WITH {RECORDS} SELECT file_number, key, size, "offset" FROM blob')
def record_offsets(s, d):
    return blob_table(s, d).select("file_number", "key", "size", "offset")


@query(f'WITH {RECORDS} SELECT file_number, max("offset") AS "offset" FROM blob WHERE "offset" <= 20000 GROUP BY file_number')
def offset_floor(s, d):
    return blob_table(s, d).filter("offset <= 20000").groupBy("file_number").agg(F.max("offset").alias("offset"))


@query(f"WITH {RECORDS} SELECT key, value FROM blob WHERE file_number = 5")
def blob_file_scan(s, d):
    return blob_table(s, d).filter("file_number = 5").select("key", "value")


@query(f"WITH {RECORDS} SELECT key, file_number FROM blob ORDER BY key, file_number")
def merge_scan(s, d):
    return blob_table(s, d).select("key", "file_number").orderBy("key", "file_number")


@query(f"WITH {RECORDS} SELECT hex(key) AS k, hex(left(value, 20)) AS v FROM blob WHERE file_number = 3")
def blob_dump_hex(s, d):
    return blob_table(s, d).filter("file_number = 3").select(F.hex("key").alias("k"), F.hex(F.left("value", F.lit(20))).alias("v"))


@query(f"WITH {RECORDS}, {INDEX} SELECT key, CASE WHEN reason IS NULL THEN value ELSE 'overwritten' END AS value FROM state WHERE reason IS NULL OR reason <> 'key deleted'")
def deref_join(s, d):
    return blobs.dereference(index_table(s, d), blob_table(s, d)).select("key", "value")


@query(f"WITH {RECORDS}, {INDEX} SELECT key, CASE WHEN file_number = 7 AND reason IS NULL THEN NULL WHEN reason IS NULL THEN value ELSE 'overwritten' END AS value, CASE WHEN file_number = 7 AND reason IS NULL THEN 'Corruption' ELSE 'OK' END AS status FROM state WHERE reason IS NULL OR reason <> 'key deleted'")
def deref_lenient(s, d):
    return blobs.dereference(index_table(s, d), blob_table(s, d).filter("file_number <> 7"), strict=False)


@query(f"WITH {RECORDS}, {INDEX} SELECT key, CASE WHEN reason IS NULL THEN value ELSE 'overwritten' END AS value FROM state WHERE reason IS NULL OR reason <> 'key deleted' ORDER BY key LIMIT 20")
def late_materialize(s, d):
    """The first keys are found without a value or an offset; only their files, 20 at most, are laid out and read."""
    held = not_deleted(s, d, large_rows(s, d).drop("value")).orderBy("key").limit(20).select("file_number").distinct()
    blob = blobs.offsets(large_rows(s, d).join(F.broadcast(held), "file_number", "left_semi"))
    return blobs.dereference(index_table(s, d, blob).orderBy("key").limit(20), blob).select("key", "value")


@query(f"WITH {RECORDS}, {INDEX} SELECT key, CASE WHEN reason IS NULL THEN value ELSE 'overwritten' END AS inline_value FROM state WHERE reason IS NULL OR reason <> 'key deleted'")
def fallback_inline(s, d):
    return blobs.dereference(index_table(s, d), blob_table(s, d)).select("key", F.col("value").alias("inline_value"))


@query(f"WITH {RECORDS}, {INDEX} SELECT count(DISTINCT file_number) AS files FROM state WHERE reason IS NULL")
def files_touched(s, d):
    return index_table(s, d).agg(F.count_distinct("pointer.file_number").alias("files"))


@query(f"WITH RECURSIVE s AS (SELECT doc_id // 250 AS part, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS key, 18 + n + {VARLEN} AS size, row_number() OVER (PARTITION BY doc_id // 250 ORDER BY doc_id) AS pos FROM (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n FROM documents)), f AS (SELECT part, key, size, pos, 0 AS file, 20 + size AS held FROM s WHERE pos = 1 UNION ALL SELECT s.part, s.key, s.size, s.pos, CASE WHEN f.held >= 65536 THEN f.file + 1 ELSE f.file END, CASE WHEN f.held >= 65536 THEN 20 ELSE f.held END + s.size FROM f JOIN s ON s.part = f.part AND s.pos = f.pos + 1) SELECT part, key, CAST(size AS BIGINT) AS size, CAST(file AS BIGINT) AS file FROM f")
def blob_rollover(s, d):
    rows = document_rows(s, d).select(F.floor(F.col("doc_id") / 250).alias("part"), "key", K.record_size(F.col("key"), F.coalesce("value", F.lit(""))).alias("size"))
    return blobs.roll_over(rows, 1 << 16)


@query(f'WITH {RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_number ORDER BY doc_id % 3, key) AS pos FROM blob) SELECT file_number, key, coalesce(lag("offset" + size) OVER (PARTITION BY file_number ORDER BY pos) = "offset", FALSE) AS sequential FROM r')
def sequential_runs(s, d):
    """Records of a file read in another order than they lie in."""
    w = Window.partitionBy("file_number").orderBy(F.col("doc_id") % 3, "key")
    return blobs.sequential(blob_table(s, d).withColumn("pos", F.row_number().over(w))).select("file_number", "key", "sequential")


# File metadata.


@query(META + "SELECT file_number, file_entries, file_size, smallest_key, largest_key, live_data_size FROM files")
def file_meta_build(s, d):
    return file_table(s, d).select("file_number", "file_entries", "file_size", "smallest_key", "largest_key", "live_data_size")


@query(f"WITH {RECORDS}, {INDEX} SELECT file_number, CAST(sum(size) AS BIGINT) AS live_data_size FROM state WHERE reason IS NULL GROUP BY file_number")
def live_bytes(s, d):
    return files.live_bytes(index_table(s, d).filter("pointer IS NOT NULL").select("pointer.*"))


@query("SELECT l_orderkey AS sst, l_suppkey AS file_number, CAST(sum(l_partkey) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL")
def sst_blob_bytes(s, d):
    return pointers(read(s, d, "lineitem")).groupBy("sst", "file_number").agg(F.sum("size").alias("bytes"))


@query("SELECT sst, string_agg(file_number || ':' || bytes, ',' ORDER BY file_number) AS bytes FROM (SELECT l_orderkey AS sst, l_suppkey AS file_number, CAST(sum(l_partkey) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL) GROUP BY sst")
def sst_blob_map(s, d):
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("bytes")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return files.index_file_bytes(pointers(read(s, d, "lineitem"))).select("sst", shown.alias("bytes"))


@query("SELECT l_suppkey AS file_number, CAST(sum(CASE WHEN l_linestatus <> 'O' THEN l_partkey ELSE -l_partkey END) AS BIGINT) AS delta FROM lineitem GROUP BY l_suppkey")
def compaction_delta(s, d):
    return files.compaction_delta(pairs_of(s, d, True), pairs_of(s, d, False))


AGED = "aged AS (SELECT file_number, file_size, live_data_size AS live, file_level, obsolete_seq, CASE WHEN state = 'OBSOLETE' THEN state WHEN file_number % 5 = 0 THEN 'PENDING_LSM' WHEN file_number % 5 = 1 THEN 'PENDING_INIT' ELSE 'NORMAL' END AS state, CASE WHEN file_number % 4 = 0 THEN NULL WHEN file_number % 5 = 0 AND file_number % 2 = 1 THEN 1000 WHEN file_number % 3 = 0 THEN -live_data_size ELSE -(live_data_size // 2) END AS delta FROM files), changed AS (SELECT *, live + CASE WHEN delta IS NULL OR state = 'OBSOLETE' THEN 0 WHEN state = 'PENDING_LSM' THEN least(delta, 0) ELSE delta END AS now FROM aged) "


@query(META + ", " + AGED + "SELECT file_number, CAST(now AS BIGINT) AS live_data_size, CASE WHEN delta IS NULL OR state IN ('OBSOLETE', 'PENDING_INIT') THEN state WHEN now = 0 THEN 'OBSOLETE' WHEN state = 'NORMAL' AND file_level >= 5 AND 1 - now / CAST(file_size - 52 AS DOUBLE) > 0.5 THEN 'TO_MERGE' ELSE 'NORMAL' END AS state, CASE WHEN delta IS NOT NULL AND state NOT IN ('OBSOLETE', 'PENDING_INIT') AND now = 0 THEN 9000 ELSE obsolete_seq END AS obsolete_seq FROM changed")
def compaction_completed(s, d):
    n, live = F.col("file_number"), F.col("live_data_size")
    state = F.when(F.col("state") == "OBSOLETE", F.col("state")).when(n % 5 == 0, "PENDING_LSM").when(n % 5 == 1, "PENDING_INIT").otherwise("NORMAL")
    aged = file_table(s, d).withColumn("state", state)
    delta = aged.filter(n % 4 != 0).select("file_number", F.when((n % 5 == 0) & (n % 2 == 1), 1000).when(n % 3 == 0, -live).otherwise(-F.floor(live / 2)).alias("delta"))
    return files.compaction_completed(aged, delta, 9000, Options(level_merge=True)).select("file_number", "live_data_size", "state", "obsolete_seq")


@query("SELECT l_orderkey AS sst, l_suppkey AS file_number, CAST(sum(l_partkey) AS BIGINT) AS size FROM lineitem GROUP BY ALL")
def sst_map_decode(s, d):
    return files.index_file_pairs(files.index_file_bytes(pointers(read(s, d, "lineitem"))))


NAMES = [("num-live-blob-file", "count(*) FILTER (state <> 'OBSOLETE')"), ("num-obsolete-blob-file", "count(*) FILTER (state = 'OBSOLETE')"), ("live-blob-size", "coalesce(sum(live_data_size) FILTER (state <> 'OBSOLETE'), 0)"), ("live-blob-file-size", "coalesce(sum(file_size) FILTER (state <> 'OBSOLETE'), 0)"), ("obsolete-blob-file-size", "coalesce(sum(file_size) FILTER (state = 'OBSOLETE'), 0)")]
NAMES += [(f"num-blob-files-at-level{k}", f"count(*) FILTER (state <> 'OBSOLETE' AND file_level = {k})") for k in range(7)]
NAMES += [(f"num-discardable-ratio-{b.lower()}-file", f"count(*) FILTER (state <> 'OBSOLETE' AND bucket = '{b}')") for b in ("LE0", "LE20", "LE50", "LE80", "LE100")]


@query(META + f", b AS (SELECT *, CASE WHEN r < 1e-9 THEN 'LE0' WHEN r <= 0.2 THEN 'LE20' WHEN r <= 0.5 THEN 'LE50' WHEN r <= 0.8 THEN 'LE80' ELSE 'LE100' END AS bucket FROM (SELECT *, {RATIO} AS r FROM files)) " + " UNION ALL ".join(f"SELECT '{name}' AS name, CAST({sql} AS BIGINT) AS value FROM b" for name, sql in NAMES))
def store_properties(s, d):
    return files.properties(file_table(s, d))


@query(META + f"SELECT file_number, round({RATIO}, 9) AS ratio FROM files")
def discardable_ratio(s, d):
    return file_table(s, d).select("file_number", F.round(K.discardable_ratio(F.col("file_size"), F.col("live_data_size")), 9).alias("ratio"))


@query(META + f"SELECT bucket, count(*) AS files FROM (SELECT CASE WHEN r < 1e-9 THEN 'LE0' WHEN r <= 0.2 THEN 'LE20' WHEN r <= 0.5 THEN 'LE50' WHEN r <= 0.8 THEN 'LE80' ELSE 'LE100' END AS bucket FROM (SELECT {RATIO} AS r FROM files WHERE state <> 'OBSOLETE')) GROUP BY bucket")
def ratio_histogram(s, d):
    return files.ratio_histogram(file_table(s, d))


@query(META + "SELECT count(*) FILTER (state <> 'OBSOLETE') AS live_files, count(*) FILTER (state = 'OBSOLETE') AS obsolete_files, CAST(coalesce(sum(file_size) FILTER (state <> 'OBSOLETE'), 0) AS BIGINT) AS live_file_size, CAST(coalesce(sum(live_data_size) FILTER (state <> 'OBSOLETE'), 0) AS BIGINT) AS live_data_size, CAST(coalesce(sum(file_size) FILTER (state = 'OBSOLETE'), 0) AS BIGINT) AS obsolete_file_size FROM files")
def file_gauges(s, d):
    return files.gauges(file_table(s, d))


@query(META + "SELECT file_level, count(*) AS files FROM files WHERE state <> 'OBSOLETE' GROUP BY file_level")
def files_per_level(s, d):
    return files.files_per_level(file_table(s, d))


@query(META + f"SELECT file_number, round(CASE WHEN file_size < 100000 THEN greatest(0.5, {RATIO}) ELSE {RATIO} END, 9) AS score FROM files WHERE state <> 'OBSOLETE'")
def gc_score(s, d):
    return files.score(file_table(s, d), Options(merge_small_file_threshold=100000)).select("file_number", F.round("score", 9).alias("score"))


PICKED = META + f", sc AS (SELECT *, {RATIO} AS score FROM files WHERE state = 'NORMAL'), p AS (SELECT *, coalesce(sum(file_size) OVER w, 0) < 1048576 AND coalesce(sum(live_data_size) OVER w, 0) < 262144 AS picked FROM sc WHERE score >= 0.05 WINDOW w AS (ORDER BY score DESC, file_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "


@query(PICKED + "SELECT file_number, picked FROM p")
def gc_pick(s, d):
    return gc.pick(file_table(s, d), OPTIONS).select("file_number", "picked")


@query(PICKED + "SELECT coalesce(sum(file_size) FILTER (NOT picked), 0) > 0 AS more FROM p")
def gc_trigger_next(s, d):
    return gc.pick(file_table(s, d), OPTIONS).agg(F.coalesce(F.bool_or("more"), F.lit(False)).alias("more"))


@query(META + "SELECT file_number FROM files WHERE file_level < 3 OR state = 'TO_MERGE'")
def level_merge_candidates(s, d):
    return files.level_merge_candidates(file_table(s, d), 3).select("file_number")


@query("WITH f AS (SELECT o_custkey AS file_number, o_custkey % 50 AS level, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey), e AS (SELECT level, file_number, a AS k, 1 AS d FROM f UNION ALL SELECT level, file_number, b, -1 FROM f), n AS (SELECT *, row_number() OVER w AS i, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS depth FROM e WINDOW w AS (PARTITION BY level ORDER BY k, d, file_number)), s AS (SELECT level, file_number, max(i) FILTER (d = 1) AS i0, max(i) FILTER (d = -1) AS i1 FROM n GROUP BY ALL) SELECT DISTINCT s.level, s.file_number FROM s JOIN n ON n.level = s.level AND n.d = 1 AND n.depth > 12 AND n.i >= s.i0 AND n.i < s.i1")
def range_merge_mark(s, d):
    return files.overlap_marks(interval_table(s, d), 12, ("level",))


@query(META + "SELECT file_number, CASE WHEN state IN ('NORMAL', 'TO_MERGE') AND smallest_key >= '00000002' AND largest_key <= '00000990' THEN 'OBSOLETE' ELSE state END AS state FROM files")
def delete_blob_files_in_range(s, d):
    return files.delete_in_ranges(file_table(s, d), [("00000002", "00000990")], True, 77).select("file_number", "state")


@query(META + "SELECT file_level, CAST(sum(live_data_size) AS BIGINT) AS dropped FROM files WHERE file_level > 0 AND state IN ('NORMAL', 'TO_MERGE') AND smallest_key >= '00000002' AND largest_key < '00000990' GROUP BY file_level")
def delete_files_in_range(s, d):
    hit = file_table(s, d).filter((F.col("file_level") > 0) & files.range_condition("00000002", "00000990", False))
    return hit.groupBy("file_level").agg(F.sum("live_data_size").alias("dropped"))


@query(META + "SELECT file_number, state FROM files")
def list_files(s, d):
    return file_table(s, d).select("file_number", "state")


@query(META + "SELECT DISTINCT file_number FROM files WHERE state = 'OBSOLETE' AND 230 > obsolete_seq")
def purge_obsolete(s, d):
    return files.purgeable(file_table(s, d), [230, 400])


STEPS = " ".join(f"WHEN e = '{event}'" + (f" AND s IN ({', '.join(repr(x) for x in on)})" if on else "") + f" THEN '{to}'" for event, on, to in files.TRANSITIONS)
EVENT = "CASE event_id % 5 WHEN 0 THEN 'FlushOrCompactionOutput' WHEN 1 THEN 'CompactionCompleted' WHEN 2 THEN 'GCBegin' WHEN 3 THEN 'GCCompleted' ELSE 'NeedMerge' END"


@query(f"SELECT user_id AS file_number, list_reduce(list_prepend('None', list({EVENT} ORDER BY event_id)), lambda s, e: CASE {STEPS} ELSE s END) AS state FROM events GROUP BY user_id")
def file_state_fold(s, d):
    return files.fold_states(state_events(s, d))


@query("SELECT event_type, CAST(quantile_disc(strlen(props), 0.5) AS INT) AS median, max(strlen(props)) AS largest FROM events GROUP BY event_type")
def size_percentiles(s, d):
    return read(s, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY octet_length(props))").cast("int").alias("median"), F.max(F.octet_length("props")).cast("long").alias("largest"))


@query("SELECT c_mktsegment, regexp_extract(c_name, '^(.*?)([0-9]*)$', 1) AS base, count(*) AS n, CAST(sum(CAST(regexp_extract(c_name, '([0-9]*)$', 1) AS BIGINT)) AS BIGINT) AS numbers FROM customer GROUP BY ALL")
def property_lookup(s, d):
    base, number = K.property_name(F.col("c_name"))
    return read(s, d, "customer").groupBy("c_mktsegment", base.alias("base")).agg(F.count("*").alias("n"), F.sum(number.cast("long")).alias("numbers"))


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS flush, count(*) FILTER (user_id % 3 = 1) AS compaction, count(*) FILTER (user_id % 3 = 2) AS gc FROM events GROUP BY event_type")
def op_stats(s, d):
    op = F.element_at(F.array(F.lit("flush"), F.lit("compaction"), F.lit("gc")), (F.col("user_id") % 3 + 1).cast("int"))
    rows = read(s, d, "events").withColumn("op", op)
    return rows.groupBy("event_type").pivot("op", ["flush", "compaction", "gc"]).count().na.fill(0)


@query(None)
def checksum(s, d):
    return document_rows(s, d).select("key", F.crc32("value").alias("crc"))


# Garbage collection.


@query(f"WITH {RECORDS}, {INDEX} SELECT key, file_number, size FROM state WHERE reason IS NULL")
def gc_live(s, d):
    return gc.live_records(blob_table(s, d), index_table(s, d)).select("key", "file_number", "size")


@query(f"WITH {RECORDS}, {INDEX} SELECT key, file_number, size FROM state WHERE reason IS NOT NULL")
def gc_discard(s, d):
    return gc.dead_records(blob_table(s, d), index_table(s, d)).select("key", "file_number", "size")


@query(f"WITH {RECORDS}, {INDEX} SELECT key, file_number, size, reason FROM state WHERE reason IS NOT NULL")
def gc_conflicts(s, d):
    return gc.conflicts(blob_table(s, d), index_table(s, d))


@query(f"WITH {RECORDS}, {INDEX} SELECT count(*) AS keys_read, CAST(sum(size) AS BIGINT) AS bytes_read, count(*) FILTER (reason IS NULL) AS keys_relocated, CAST(coalesce(sum(size) FILTER (reason IS NULL), 0) AS BIGINT) AS bytes_relocated, count(*) FILTER (reason IS NOT NULL) AS keys_overwritten, CAST(coalesce(sum(size) FILTER (reason IS NOT NULL), 0) AS BIGINT) AS bytes_overwritten, count(DISTINCT file_number) AS files_in FROM state")
def gc_metrics(s, d):
    return gc.metrics(blob_table(s, d), index_table(s, d))


@query(f"WITH {RECORDS}, {INDEX}, l AS (SELECT key, size, 1000000 + file_number // 4 AS file_number FROM state WHERE reason IS NULL) SELECT file_number, key, CAST(20 + coalesce(sum(size) OVER (PARTITION BY file_number ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM l")
def gc_rewrite(s, d):
    live = gc.live_records(blob_table(s, d), index_table(s, d)).select("key", "value", (F.floor(F.col("file_number") / 4) + 1000000).alias("file_number"))
    return blobs.offsets(live).select("file_number", "key", "offset")


# A collection of a third of the files.  Keys that were overwritten in the meantime had pointers when it began.
MOVED = f"WITH {RECORDS}, {INDEX}, {FILES}, p AS (SELECT key, size, reason, file_number AS old, 1000000 + file_number // 4 AS new_file FROM state WHERE reason IS DISTINCT FROM 'key deleted' AND file_number % 3 = 1), moved AS (SELECT *, CAST(20 + coalesce(sum(size) OVER (PARTITION BY new_file ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM p) "


def collected(s: SparkSession, d: str) -> DataFrame:
    lab = read(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    then = blob_table(s, d).join(lab, "doc_id", "left").filter("coalesce(quality, 1) <> 0").select("key", F.struct("file_number", "offset", "size").alias("pointer"))
    return gc.relocate(blob_table(s, d), then, F.col("file_number") % 3 == 1, F.floor(F.col("file_number") / 4) + 1000000)


@query(MOVED + 'SELECT s.key, coalesce(new_file, s.file_number) AS file_number, coalesce(new_offset, s."offset") AS "offset" FROM state s LEFT JOIN moved m ON m.key = s.key WHERE s.reason IS NULL')
def gc_install(s, d):
    after = gc.install(collected(s, d), index_table(s, d)).filter("pointer IS NOT NULL")
    return after.select("key", "pointer.file_number", "pointer.offset")


@query(MOVED + "SELECT new_file AS file_number, CAST(sum(size) AS BIGINT) AS dropped FROM moved WHERE reason IS NOT NULL GROUP BY new_file")
def gc_dropped_bytes(s, d):
    return gc.dropped_bytes(collected(s, d), index_table(s, d))


@query(META + "SELECT file_number, CASE WHEN file_number % 3 = 1 THEN 'OBSOLETE' ELSE state END AS state, CASE WHEN file_number % 3 = 1 AND state <> 'OBSOLETE' THEN 9000 ELSE obsolete_seq END AS obsolete_seq FROM files")
def gc_finish(s, d):
    return gc.finish(file_table(s, d), F.col("file_number") % 3 == 1, 9000).select("file_number", "state", "obsolete_seq")


# The manifest.


@query(EDITS + "SELECT file_number, edit_id FROM (SELECT *, row_number() OVER (PARTITION BY file_number ORDER BY edit_id DESC) AS rn FROM edits WHERE kind <> 'NEXT_FILE') WHERE rn = 1 AND kind = 'ADD'")
def manifest_replay(s, d):
    return manifest.replay(edit_table(s, d))


@query(EDITS + ", w AS (SELECT *, lag(kind) OVER (PARTITION BY file_number ORDER BY edit_id) AS b FROM edits WHERE kind <> 'NEXT_FILE') SELECT edit_id, file_number, CASE WHEN kind = 'ADD' THEN 'added twice' WHEN b IS NULL THEN 'unknown file' ELSE 'deleted twice' END AS fault FROM w WHERE (kind = 'ADD' AND b = 'ADD') OR (kind = 'DELETE' AND (b IS NULL OR b = 'DELETE'))")
def manifest_validate(s, d):
    return manifest.faults(edit_table(s, d))


@query(EDITS + "SELECT edit_id, file_number, 'next file number decreases' AS fault FROM (SELECT *, lag(file_number) OVER (ORDER BY edit_id) AS b FROM edits WHERE kind = 'NEXT_FILE') WHERE file_number < b")
def manifest_next_file(s, d):
    return manifest.backward_numbers(edit_table(s, d))


@query(EDITS + ", a AS (SELECT DISTINCT file_number FROM edits WHERE kind = 'ADD'), x AS (SELECT DISTINCT file_number FROM edits WHERE kind = 'DELETE') SELECT file_number, 'live' AS what FROM a WHERE file_number NOT IN (SELECT * FROM x) UNION ALL SELECT file_number, 'deleted only' FROM x WHERE file_number NOT IN (SELECT * FROM a)")
def manifest_dump(s, d):
    return manifest.dump(edit_table(s, d))


@query("WITH e AS (SELECT DISTINCT o_orderkey // 100 AS edit_id, o_custkey AS file_number, o_orderstatus AS s FROM orders) SELECT a.edit_id, a.file_number FROM e a JOIN e b ON a.edit_id = b.edit_id AND a.file_number = b.file_number WHERE a.s = 'O' AND b.s = 'F'")
def manifest_cancelled(s, d):
    return manifest.cancelled(edit_table(s, d).withColumn("edit_id", F.floor(F.col("edit_id") / 100)))


@query(EDITS + "SELECT 'ADD' AS kind, file_number FROM (SELECT *, row_number() OVER (PARTITION BY file_number ORDER BY edit_id DESC) AS rn FROM edits WHERE kind <> 'NEXT_FILE') WHERE rn = 1 AND kind = 'ADD' AND file_number % 11 <> 0")
def manifest_snapshot(s, d):
    known = read(s, d, "customer").select(F.col("c_custkey").alias("file_number"), F.when(F.col("c_custkey") % 11 == 0, "OBSOLETE").otherwise("NORMAL").alias("state"))
    return manifest.snapshot(edit_table(s, d), known)


@query("SELECT c_custkey AS file_number FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_files(s, d):
    return manifest.orphans(read(s, d, "customer").select(F.col("c_custkey").alias("file_number")), read(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("file_number")))


@query(META + "SELECT file_number, file_size FROM files WHERE state <> 'OBSOLETE'")
def checkpoint_files(s, d):
    return file_table(s, d).filter("state <> 'OBSOLETE'").select("file_number", "file_size")
