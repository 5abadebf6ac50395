"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kvspark.llm.common import components, materialize, mix

_U = np.uint64
LEAST = 0.9
#: Tables, projections in a table, and the width of a projection's cells on unit vectors.  A pair at cosine 0.9 lies
#: 0.447 apart; it shares a cell with chance 0.70, a bucket with 0.058, one of the buckets with 0.95.
TABLES, PROJECTIONS, CELL = 50, 8, 1.2
#: Members of one block when a bucket is compared block by block.
BLOCK = 1024


def units(x: np.ndarray) -> np.ndarray:
    """The rows of a matrix at length 1, in double precision; very large and very small ones are scaled first."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True, initial=0.0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def buckets(x: np.ndarray, seed: int) -> np.ndarray:
    """Bucket keys of 32 bits, a column for each table."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a = rng.standard_normal((x.shape[1], TABLES * PROJECTIONS))
    cells = np.floor((x @ a + rng.uniform(0, CELL, TABLES * PROJECTIONS)) / CELL).astype(np.int64).view(np.uint64)
    h = np.tile(mix(np.arange(TABLES, dtype=np.uint64) + _U(x.shape[1] * 1000)), (len(x), 1))
    for k in range(PROJECTIONS):
        h = mix(h + cells[:, k::PROJECTIONS] * _U(0x9E3779B97F4A7C15))
    return (h >> _U(32)).astype(np.uint32).view(np.int32)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _compare(table):
    """Of each bucket's one or two blocks: links of each member that no earlier table finds, and who is tied to whom.

    A pair counts in the first table in which its buckets are equal.  Ties name, for each member, the least class
    of its component among the links of this comparison, which are no more rows than members.
    """
    ids, copies, t, bucket, i, j, block = (table.column(c).to_numpy(zero_copy_only=False) for c in ("class", "copies", "t", "bucket", "i", "j", "block"))
    x, keys = units(_matrix(table.column("x"))), _matrix(table.column("keys"))
    order = np.lexsort((j, i, bucket, t))
    change = np.zeros(len(order), bool)
    for c in (t, bucket, i, j):
        change[1:] |= np.diff(c[order]) != 0
    out = [(np.zeros(0, np.int64),) * 3]
    for at in np.split(order, np.flatnonzero(change)):
        a, b = (at, at) if i[at[0]] == j[at[0]] else (at[block[at] == i[at[0]]], at[block[at] == j[at[0]]])
        p, q = np.nonzero(x[a] @ x[b].T >= LEAST)
        p, q = a[p], b[q]
        if a is b:
            p, q = p[p < q], q[p < q]
        if t[at[0]] and len(p):
            new = [~(keys[p[k : k + 200_000], : t[at[0]]] == keys[q[k : k + 200_000], : t[at[0]]]).any(1) for k in range(0, len(p), 200_000)]
            p, q = p[np.concatenate(new)], q[np.concatenate(new)]
        if not len(p):
            continue
        hit, both = np.unique(np.concatenate([p, q]), return_inverse=True)
        p, q = both[: len(p)], both[len(p) :]
        n = np.bincount(p, copies[hit][q], len(hit)) + np.bincount(q, copies[hit][p], len(hit))
        label = ids[hit]
        while (label[p] != label[q]).any():
            low = np.minimum(label[p], label[q])
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
        out.append((ids[hit], n.astype(np.int64), label))
    return pa.table(dict(zip(("class", "links", "tie"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def near_vectors(vectors: DataFrame, *, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of each row: others at cosine 0.9 or more, least id that links reach, and
    whether that is the row's own.

    Cosines are of doubles.  Vectors that are null, empty, zero or hold a null or a value that isn't finite link with
    nothing.  Rows of equal direction are one class, compared once and counted by their number; repeated ids are rows
    of their own, a null id names no component but its own null.  Vectors of different lengths link with nothing of
    another length.  An empty table gives an empty table; other columns are not read.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    bad = F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    fine = rows.filter(~bad & F.exists("v", lambda e: e != 0))
    classes = fine.groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()))

    def sign(batches):
        for batch in batches:
            v = batch.column(1)
            counts = np.diff(v.offsets.to_numpy())
            for size in np.unique(counts):
                at = pa.array(np.flatnonzero(counts == size))
                part = v.take(at)
                h = buckets(units(_matrix(part)), seed)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(np.full(len(h), size, np.int32)), part, keys], ["class", "copies", "size", "x", "keys"])

    signed = materialize(classes.select("class", "v", "copies").mapInArrow(sign, f"class long, copies long, size int, x array<{kind}>, keys array<int>"))
    posted = signed.select("class", F.posexplode("keys").alias("t", "bucket"))
    met = materialize(posted.groupBy("t", "bucket").agg(F.count("*").alias("members")).filter("members > 1"))
    shared = materialize(posted.join(met, ["t", "bucket"]), met)
    n = F.ceil(F.col("members") / BLOCK).cast("int")
    # Buckets of one block share calls of some thousand rows; each pair of blocks of a larger one has its own.
    calls = max(1, shared.count() // 4000)
    placed = shared.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("class"), F.col("n")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    placed = placed.withColumn("ij", F.explode(meets)).select("t", "bucket", "class", "block", "ij.*", "n")
    together = F.when(F.col("n") == 1, F.pmod(F.xxhash64("t", "bucket"), F.lit(calls))).otherwise(F.xxhash64("t", "bucket", "i", "j"))
    placed = placed.withColumn("together", together).drop("n").join(signed, "class")
    found = materialize(placed.groupBy("size", "together").applyInArrow(_compare, "class long, links long, tie long"), shared, signed)
    linked = materialize(found.groupBy("class").agg(F.sum("links").alias("links")))
    reached = components(found.select(F.col("class").alias("a"), F.col("tie").alias("b")))
    owners = classes.select("class", "copies", "first", "v").join(linked, "class", "left").join(reached.withColumnRenamed("node", "class"), "class", "left")
    owners = materialize(owners.select("v", "copies", "first", F.coalesce("component", "class").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), classes, linked, reached, found)
    named = materialize(owners.groupBy("component").agg(F.min("first").alias("component_id")))
    owners = materialize(owners.join(named, "component").select("v", "copies", "links", "component_id"), owners, named)
    good = fine.join(owners, "v").select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.filter(bad | ~F.exists("v", lambda e: e != 0)).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_vectors(spark, sf_dir: str) -> DataFrame:
    """The query: all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
