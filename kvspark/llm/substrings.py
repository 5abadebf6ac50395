"""Removal of repeated byte strings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every 400-byte window names an anchor, its k-gram of least hash, so equal windows share one; neighbouring windows with
one anchor are a run.  Runs that occur twice as a whole repeat throughout.  Of anchors with several different runs, the
runs' bytes are gathered by anchor in bounded groups; in each, backward extension on the transform, breadth first from
the strings of the few symbols that are sorted at once, finds where suffixes part in increasing order of what they share,
up to 399 symbols, and those that haven't parted then share 400 or more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kvspark.llm.common import _U, SLICE_BYTES, materialize, prefix_sums, range_hash, slices, text_bytes

LENGTH = 400
#: Longer k-grams make more runs of a text but fewer that share an anchor and no window.
GRAM = 128
#: Bytes of runs in one group, and runs of one anchor beyond which its windows are counted by hash in Spark instead.
GROUP_BYTES, MOST_RUNS = 192 << 10, 48
#: Groups of one task.
TASK_GROUPS = 4


def window_runs(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, content hash, start within the row, windows) of the runs of rows laid end to end."""
    size = np.diff(offsets)
    if not len(buf) or size.max() < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(buf) >= SLICE_BYTES + length:  # in parts that share no window; a run across their border becomes two
        parts = []
        for k in np.flatnonzero(size >= length):
            for s in range(0, int(size[k]) - length + 1, SLICE_BYTES):
                part = buf[offsets[k] + s : min(offsets[k] + s + SLICE_BYTES + length - 1, offsets[k + 1])]
                row, anchor, content, start, n = window_runs(part, np.array([0, len(part)]), length)
                parts.append((row + k, anchor, content, start + s, n))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    gram, span = min(GRAM, length), length - min(GRAM, length) + 1
    sums = prefix_sums(buf)
    at = np.arange(len(buf) - gram + 1)
    h = range_hash(sums, at, at + gram)
    # Least value of each span of k-grams by block-wise running minima from both sides; positions fit in 24 bits.
    value = (h >> _U(24) << _U(24)) | at.astype(np.uint64)
    blocks = -(-len(value) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max)
    padded[: len(value)] = value
    ahead = np.minimum.accumulate(padded.reshape(blocks, span), 1).ravel()
    back = np.minimum.accumulate(padded.reshape(blocks, span)[:, ::-1], 1)[:, ::-1].ravel()
    n = np.maximum(size - length + 1, 0)
    rows = np.repeat(np.arange(len(size)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][rows]
    anchor = (np.minimum(back[start], ahead[start + span - 1]) & _U((1 << 24) - 1)).astype(np.int64)
    first = np.ones(len(start), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    f = np.flatnonzero(first)
    count = np.diff(np.append(f, len(start)))
    return rows[f], h[anchor[f]], range_hash(sums, start[f], start[f] + count - 1 + length), start[f] - offsets[:-1][rows[f]], count


def transform(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols of the parts with a different end sign after each; suffixes in the order of their first length symbols; of
    each row and one more, whether its suffix shares less than step symbols with the one before, and exactly step - 1; step."""
    data = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    text = data.astype(np.int64) + len(parts)
    text[ends] = np.arange(len(parts))
    # As many symbols as fit in 63 bits with the place are sorted at once: 0 is an end sign and all behind it.
    dense = np.cumsum(np.bincount(data, minlength=256) > 0)
    n, bits, width = len(text), len(text).bit_length(), int(dense[-1]).bit_length()
    step, places = min(max((63 - bits) // width, 1), length), (1 << bits) - 1
    sign = np.zeros(n + step, np.int64)
    sign[:n] = dense[data]
    sign[ends] = 0
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(step):
        key = key << width | sign[k : n + k]
    for k in range(step):
        at, rest = np.maximum(ends - k, 0), width * (step - 1 - k)
        ended[at], key[at] = True, key[at] >> rest << rest
    key = np.sort(key << bits | np.arange(n))
    order, key = key & places, key >> bits
    alone, apart = ended[order], key[1:] ^ key[:-1]
    less, last = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    less[1:-1] = (apart != 0) | alone[1:]
    last[1:-1] = (apart >> width == 0) & less[1:-1] & ((apart != 0) | (step == 1) | (key[1:] >> width & (1 << width) - 1 != 0))
    last[n] = step == 1
    # Rows that share their first symbols are sorted by the rank of what follows, twice as many symbols each time.
    first, rank, done = less.copy(), np.empty(n, np.int64), step
    rank[order] = np.maximum.accumulate(np.where(first[:-1], np.arange(n), 0))
    rows = np.flatnonzero(~(first[:-1] & first[1:]))
    while len(rows) and done < length:
        at = order[rows]
        key = rank[at] << bits | rank[at + done]
        if 3 * bits <= 63:
            key = np.sort(key << bits | at)
            at, key = key & places, key >> bits
        else:
            o = np.argsort(key)
            at, key = at[o], key[o]
        first = np.concatenate([[True], key[1:] != key[:-1], [True]])
        order[rows] = at
        rank[at] = rows[np.maximum.accumulate(np.where(first[:-1], np.arange(len(rows)), 0))]
        rows = rows[~(first[:-1] & first[1:])]
        done *= 2
    return text, order, less, last, step


def repeated(parts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Whether the length symbols from each place on, in the parts with an end sign after each, also start elsewhere."""
    text, order, known, last, step = transform(parts, length)
    n = len(text)
    bits, head = n.bit_length(), text[order]
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    back = row[order - 1]  # the row of the suffix that is longer by one at its head
    # Intervals of step symbols, as if expanded from the empty string: those whose end is first known at this depth.
    low = np.flatnonzero(known[:-1])
    high = np.append(low[1:], n) - 1
    low, high = low[last[high + 1]], high[last[high + 1]]
    for _ in range(step, length):
        if not len(low):
            break
        size = high - low + 1
        single = size == 1
        alone = back[low[single]]
        low, size = low[~single], size[~single]
        if len(low):
            end = np.cumsum(size)
            key = np.repeat(np.arange(len(low)), size) << bits | back[np.arange(end[-1]) + np.repeat(low - end + size, size)]
            key.sort()  # by interval and sign; the rows of one sign follow each other
            to = key & ((1 << bits) - 1)
            sign = (key >> bits << 32) | head[to]
            cut = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
            low, high = np.concatenate([to[cut], alone]), np.concatenate([to[np.append(cut[1:], len(to)) - 1], alone])
        else:
            low = high = alone
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
    out = np.zeros(n, bool)
    out[order] = ~(known[:-1] & known[1:])
    return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def _extend(table):
    """Ranges of repeated windows in the runs of one group."""
    keys = list(zip(table.column("anchor").to_pylist(), table.column("content").to_pylist(), strict=True))
    parts = dict(zip(keys, table.column("bytes").to_pylist(), strict=True))  # one of equal runs
    flags = repeated(list(parts.values()))
    rows, at = [], 0
    for (anchor, content), p in parts.items():
        for a, b in zip(*_ranges(flags[at : at + len(p)]), strict=True):
            rows.append((anchor, content, int(a), int(b)))
        at += len(p) + 1
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor", "content", "a", "b"), cols, strict=True)})


def _runs(batches):
    for batch in batches:
        buf, offsets = text_bytes(batch.column(3))
        for a, b in slices(offsets):
            row, anchor, content, start, n = window_runs(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if len(row):
                ids = [batch.column(k).slice(a, b - a).take(pa.array(row)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(start), pa.array(n)], ["id", "c1", "c2", "anchor", "content", "start", "n"])


def _bytes(batches):
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            cols = [[w[k] for w in wanted] for k in ("anchor", "content")]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([data[w["start"] : w["start"] + w["n"] - 1 + LENGTH] for w in wanted], pa.binary())], ["anchor", "content", "bytes"])


def _windows(batches):
    """Hashes of the single windows of runs."""
    for batch in batches:
        for anchor, content, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            sums = prefix_sums(np.frombuffer(data, np.uint8))
            at = np.arange(len(data) - LENGTH + 1)
            h = range_hash(sums, at, at + LENGTH).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), anchor)), pa.array(np.full(len(at), content)), pa.array(at), pa.array(h)], ["anchor", "content", "a", "h"])


def find_repeats(docs: DataFrame) -> DataFrame:
    """(c1, c2, spans array<struct<a, b>>): of texts by their two hashes, the byte ranges that repeated strings cover, in
    order.  docs: id, c1, c2, text."""
    kind = docs.schema["id"].dataType.simpleString()
    every = materialize(docs.select("id", "c1", "c2", "text").mapInArrow(_runs, f"id {kind}, c1 long, c2 long, anchor long, content long, start long, n long"))
    often = materialize(every.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"))
    runs = materialize(every.join(often, "anchor"), every, often)
    one = runs.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.max("n").alias("n"), F.min(F.struct("id", "c1", "c2", "start")).alias("at"))
    one = materialize(one)
    several = materialize(one.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    wanted = materialize(one.join(several, "anchor").select("at.*", "anchor", "content", "n", "kinds"))
    per = wanted.groupBy("id", "c1", "c2").agg(F.collect_list(F.struct("anchor", "content", "start", "n")).alias("wanted"))
    on = [docs[c].eqNullSafe(per[c]) for c in ("id", "c1", "c2")]
    found = docs.join(per, on).select(docs["text"], "wanted").mapInArrow(_bytes, "anchor long, content long, bytes binary")
    found = materialize(found.join(several, "anchor"), several, wanted)
    total = found.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    few = found.filter(F.col("kinds") <= MOST_RUNS).withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(1 + total // GROUP_BYTES)))
    # The work lies in Python, so tasks are dealt out by groups, not by what little they read.
    short = few.repartition(1 + total // (GROUP_BYTES * TASK_GROUPS), "group").groupBy("group").applyInArrow(_extend, "anchor long, content long, a long, b long")
    windows = found.filter(F.col("kinds") > MOST_RUNS).select("anchor", "content", "bytes").mapInArrow(_windows, "anchor long, content long, a long, h long")
    again = windows.groupBy("h").agg(F.count("*").alias("k"))
    again = materialize(again.filter("k > 1").select("h"))
    single = windows.join(again, "h").select("anchor", "content", "a", (F.col("a") + 1).alias("b"))
    whole = one.filter("times > 1").select("anchor", "content", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    spans = materialize(short.unionByName(single).unionByName(whole), one, found, again)
    place = F.col("start") + F.col("a")
    covered = runs.join(spans, ["anchor", "content"]).select("c1", "c2", place.alias("a"), (place + F.col("b") - F.col("a") - 1 + LENGTH).alias("b")).distinct()
    return materialize(covered.groupBy("c1", "c2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")), runs, spans)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row.

    A byte is removed if a string of LENGTH bytes covers it that also starts anywhere else, in the same row or another;
    overlaps count, and texts are judged as they came.  Null texts are empty; rows repeat each other like any others;
    null ids stay; an empty table gives an empty table; other columns of docs are not read.  Texts and strings are
    told apart by 96- and 64-bit hashes.  kept is binary: the rest of a text may break a character.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("c1"), F.hash(text).cast("long").alias("c2"), text.alias("text"))
    joined = rows.join(find_repeats(rows), ["c1", "c2"], "left").select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = value.as_buffer().to_pybytes()
                kept, at, n = [], 0, 0
                for s in spans.as_py() or ():
                    if n == 0 or s["a"] > at:
                        kept.append(data[at : s["a"]])
                        n += 1
                    at = max(at, s["b"])
                rest = b"".join(kept) + data[at:]
                out.append((len(data), len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    found = found.withColumnRenamed("id", id_col)
    return found if keep_text else found.drop("kept")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
