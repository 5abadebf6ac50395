"""Shared pieces: tables in the shared folder, byte-level word splitting, hashing, components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass handles; bounds a worker's memory, never the result.
SLICE_BYTES = 1 << 20


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(spark, "_kvspark_shared", None) or "file://" + tempfile.mkdtemp(prefix="kvspark-")
        spark._kvspark_shared = at
    return at.rstrip("/")


@contextmanager
def _cleaning(spark: SparkSession):
    """Within it, Spark removes a query's shuffle files when the query ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage is cut, executors may go.

    done: earlier results of this function that nothing but df reads; they are deleted once df is written.
    """
    spark, at = df.sparkSession, shared_dir(df.sparkSession)
    base = "kvspark_" + hashlib.sha1(at.encode()).hexdigest()[:12]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {base} LOCATION '{at}/{base}'")
    table = f"{base}.t_{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.format("parquet").saveAsTable(table)
    drop(*done)
    return _table(spark.table(table), table)


def _table(df: DataFrame, name: str) -> DataFrame:
    df._kvspark_table = name
    return df


def drop(*done: DataFrame) -> None:
    """Deletes tables that materialize() has written."""
    for df in done:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._kvspark_table}")


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """Marks a written table for broadcast if its counted rows are within the bound; else a shuffle joins it."""
    return F.broadcast(df) if df.count() <= most_rows else df


_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: P**i and P**-i modulo 2**64 of the first places, and of every so many places; the latter grow by 16 bytes a block of text.
_BLOCK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _series(p: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(p % 2**64))]))


_DOWN = pow(int(_P), -1, 1 << 64)
_NEAR = {p: _series(p, _BLOCK) for p in (int(_P), _DOWN)}


def _power(p: int, i: np.ndarray) -> np.ndarray:
    """p**i modulo 2**64."""
    if not len(i) or (last := int(i.max())) < _BLOCK:
        return _NEAR[p][i]
    return _NEAR[p][i % _BLOCK] * _series(pow(p, _BLOCK, 1 << 64), last // _BLOCK + 1)[i // _BLOCK]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix hash of a byte array; one longer than it."""
    out = np.zeros(len(buf) + 1, np.uint64)
    for a in range(0, len(buf), _BLOCK):
        part = _BYTE[buf[a : a + _BLOCK]] * _NEAR[int(_P)][: len(buf) - a]
        part *= _U(pow(int(_P), a, 1 << 64))
        np.cumsum(part, out=out[a + 1 : a + 1 + len(part)])
        out[a + 1 : a + 1 + len(part)] += out[a]
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal bytes give equal hashes wherever they lie."""
    return mix((sums[end] - sums[start]) * _power(_DOWN, start) + (end - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after the other, and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return buf, at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (a, b) of at most limit bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def split_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of rows laid end to end at offsets (offsets[0] is 0)."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    word = ~_SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    rows = offsets[:-1][np.diff(offsets) > 0]
    first[rows] = word[rows]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = word[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lowered words of each row, and their row numbers."""
    low = _LOWER[buf]
    start, end, row = split_words(low, offsets)
    return range_hash(prefix_sums(low), start, end) if len(start) else np.zeros(0, np.uint64), row


def ordered_shingles(words: np.ndarray, row: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their rows, in the order of the text; a row of fewer words gives its whole sequence as one."""
    count = np.bincount(row, minlength=n_rows)
    at = np.concatenate([[0], np.cumsum(count)])
    made = np.maximum(np.where(count > 0, 1, 0), count - width + 1)
    if not made.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n_rows), made)
    begin = at[:-1].repeat(made) + np.arange(made.sum()) - np.concatenate([[0], np.cumsum(made)])[:-1].repeat(made)
    length = np.minimum(count, width)[doc]
    h = length.astype(np.uint64)
    for k in range(width):
        inside = k < length
        h = np.where(inside, mix(h + words[np.minimum(begin + k, len(words) - 1)] + _P), h)
    return h, doc


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and hash."""
    h, doc = ordered_shingles(words, row, n_rows, width)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def long_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column out of flat 64-bit values and the number of them in each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable over the undirected edges (a, b).

    Alternating large-star and small-star rounds; each is a group-by on long pairs whose minima are combined
    before the shuffle and whose result is written, so a lost executor costs one round at most.
    The driver sees only whether a round left anything to do: nothing is left once each node has either larger neighbours
    only or a single, smaller one.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smaller, larger = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), ((smaller > 1) | ((smaller > 0) & (larger > 0))).alias("open"))
        low = materialize(low.select("u", F.least("u", "m").alias("m"), "open"))
        if low.filter("open").isEmpty():
            drop(low)
            return _table(e.select(F.col("u").alias("node"), F.col("v").alias("component")), e._kvspark_table)
        # large star: each larger neighbour of u is tied to the least neighbour of u
        large = e.select(F.col("u").alias("big"), F.col("v").alias("u")).join(small(low), "u").select(F.col("big").alias("u"), F.col("m").alias("v"))
        # the node itself is tied to its least neighbour as well
        large = materialize(large.unionByName(low.filter("u <> m").select("u", F.col("m").alias("v"))).filter("u <> v"), e, low)
        # small star: smaller neighbours of u are tied to the least of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        e = large.join(small(least), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(e.filter("u <> v").distinct(), large, least)
