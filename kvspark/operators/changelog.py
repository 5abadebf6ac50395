"""The changelog (cf, key, seq, op, value): versions, snapshots, lookups, scans and deletes.

The newest version of a key is a max_by aggregate, which combines before the shuffle, so a key with very many
versions is no task of its own.  Bounds and snapshots are plain predicates that reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def as_of(log: DataFrame, snapshot: int | None = None, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The newest version of each key at the snapshot, tombstones included."""
    seen = log if snapshot is None else log.filter(F.col("seq") <= snapshot)
    rest = [c for c in log.columns if c not in keys]
    newest = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return newest.select(*keys, *(F.col(f"v.{c}").alias(c) for c in rest))


def latest(log: DataFrame, snapshot: int | None = None, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The live entries at the snapshot."""
    return as_of(log, snapshot, keys).filter("op <> 'DELETE'")


def point_get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The value of a key, or no row; the key's predicate reaches the scan."""
    return latest(log.filter(F.col("key") == F.lit(key)), snapshot)


def multi_get(log: DataFrame, requests: DataFrame, snapshot: int | None = None) -> DataFrame:
    """requests (pos, key) with value and status, one row each; only versions of asked keys are compared."""
    asked = requests.select("key").distinct()
    found = latest(log.join(asked, "key", "left_semi"), snapshot).select("key", "value", F.lit("OK").alias("status"))
    return requests.join(found, "key", "left").select("pos", "key", "value", F.coalesce("status", F.lit("NotFound")).alias("status"))


def scan(log: DataFrame, *, lower=None, upper=None, prefix=None, snapshot: int | None = None, reverse: bool = False, limit: int | None = None, key_only: bool = False, sort: bool = True, order_key: Column | None = None) -> DataFrame:
    """Live entries with lower <= key < upper and the prefix, in key order; limit is a top-n, not a full sort.

    order_key is an order of one's own, by which rows are sorted and which the bounds are compared with.
    """
    place = F.col("key") if order_key is None else order_key
    if lower is not None:
        log = log.filter(place >= F.lit(lower))
    if upper is not None:
        log = log.filter(place < F.lit(upper))
    if prefix is not None:
        log = log.filter(F.startswith(F.col("key"), F.lit(prefix)))
    if key_only:
        log = log.drop("value")
    rows = latest(log, snapshot)
    if sort:
        rows = rows.orderBy(place.desc() if reverse else place)
    return rows if limit is None else rows.limit(limit)


def seek(log: DataFrame, target, n: int = 1, snapshot: int | None = None) -> DataFrame:
    """The first n live entries at or after target."""
    return scan(log, lower=target, limit=n, snapshot=snapshot)


def seek_for_prev(log: DataFrame, target, snapshot: int | None = None) -> DataFrame:
    """The last live entry at or before target."""
    return latest(log.filter(F.col("key") <= F.lit(target)), snapshot).orderBy(F.col("key").desc()).limit(1)


def snapshots(log: DataFrame, at: list[int]) -> DataFrame:
    """Live entries at each snapshot of at: one aggregate for each, which all combine before one shuffle by key."""
    newest = [F.max_by(F.struct("seq", "op", "value"), F.when(F.col("seq") <= snap, F.col("seq"))).alias(f"at_{k}") for k, snap in enumerate(at)]
    entries = F.array(*(F.struct(F.lit(snap).alias("snap"), F.when(F.col(f"at_{k}.seq") <= snap, F.col(f"at_{k}")).alias("v")) for k, snap in enumerate(at)))
    rows = log.groupBy("key").agg(*newest).select("key", F.explode(entries).alias("x")).filter("x.v.op = 'PUT'")
    return rows.select("x.snap", "key", "x.v.seq", "x.v.value")


def write_batch(log: DataFrame, *batches: DataFrame) -> DataFrame:
    """log with batches (key, op, value, pos) appended, each entry newer than all before it.

    Numbers follow the batch and pos, which is unique in a batch.
    """
    top, out = log.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar(), log
    for b in batches:
        out = out.unionByName(b.select("key", (top + F.col("pos")).alias("seq"), "op", "value"), allowMissingColumns=True)
        top = top + b.agg(F.coalesce(F.max("pos"), F.lit(0))).scalar()
    return out


def ingest(log: DataFrame, rows: DataFrame) -> DataFrame:
    """log with the rows (key, value) as its newest versions, all at one number."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).scalar()
    return log.unionByName(rows.select("key", top.alias("seq"), F.lit("PUT").alias("op"), "value"), allowMissingColumns=True)


def compact_range(log: DataFrame, begin=None, end=None) -> DataFrame:
    """log with begin <= key < end rewritten: of each key there its newest version alone, none of a deleted one; None is no bound."""
    inside = F.lit(True)
    if begin is not None:
        inside &= F.col("key") >= F.lit(begin)
    if end is not None:
        inside &= F.col("key") < F.lit(end)
    return log.filter(~inside).unionByName(latest(log.filter(inside)).select(log.columns))


def delete_range(log: DataFrame, tombstones: list[tuple[object, object, int]]) -> DataFrame:
    """log without the versions that a range tombstone (lo, hi, seq) covers: lo <= key < hi and older than it."""
    hit = [(F.col("key") >= F.lit(lo)) & (F.col("key") < F.lit(hi)) & (F.col("seq") < seq) for lo, hi, seq in tombstones]
    return log.filter(~reduce(lambda a, b: a | b, hit)) if hit else log


def compaction_filter(log: DataFrame, remove: Column, snapshot: int | None = None) -> DataFrame:
    """Live entries that the filter doesn't remove; an unknown verdict keeps."""
    return latest(log, snapshot).filter(~F.coalesce(remove, F.lit(False)))


def expire(log: DataFrame, time: Column, now: Column, ttl: int) -> DataFrame:
    """Live entries that aren't older than ttl; the age is compared strictly.  now may be a scalar subquery."""
    return latest(log).filter(~(now - time > ttl))


def merge(*_):
    """Merge operands are refused, as single deletes are."""
    raise NotImplementedError("merge operands and single deletes are not supported")


single_delete = merge


def fold_append(log: DataFrame, part: int = 10_000) -> DataFrame:
    """All values of each key in the order of their numbers, joined by commas.

    Values are folded by runs of part numbers first, so a key with very many is no task of its own until its folded
    value is put together.
    """
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda r: r["value"]), ",").alias("value")
    runs = log.groupBy("key", F.floor(F.col("seq") / part).alias("run")).agg(joined(F.collect_list(F.struct("seq", "value"))))
    return runs.groupBy("key").agg(joined(F.collect_list(F.struct("run", "value"))))
