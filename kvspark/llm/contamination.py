"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the power of two that their number of shingles reaches, u at most; documents are read in
windows of 2u shingles every u, so an item lies in a window at most twice and a half its size wherever it stands, and
a long document hides no short item.  A window and an item that share a least hash under one of the permutations are
candidates; at containment 0.8 in a window of 2u shingles their Jaccard similarity is 0.19 or more and 64 permutations
miss them with a chance of 1.4e-6 at most.  Candidates are verified on the whole document's set of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from kvspark.llm.common import _U, mix, ordered_shingles, shingles, slices, text_bytes, word_hashes

PERMUTATIONS = 64
CONTAINED = 0.8
#: Bounds of the items of one broadcast: bytes of text, and items, each of which takes 12 bytes for every permutation.
#: More items are searched in further passes over the documents.
MOST_ITEM_BYTES, MOST_ITEMS = 16 << 20, 20_000
SEEDS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class Items:
    """Shingles of items, and for each size partition and permutation the items' least hashes."""

    def __init__(self, ids: list, texts: list[str]):
        buf, offsets = text_bytes(pa.array(texts, pa.string()))
        h, row = shingles(*word_hashes(buf, offsets), len(texts))
        self.ids, self.h = ids, h
        self.at = np.searchsorted(row, np.arange(len(texts) + 1))
        size = np.diff(self.at)
        u = 1 << np.maximum(2, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wanted = [np.zeros(0, np.uint64)]
        for size_class in np.unique(u[size > 0]).tolist():
            of = np.flatnonzero((u == size_class) & (size > 0))
            least = np.stack([own[np.argmin(mix(own[None, :] ^ SEEDS[:, None]), 1)] for own in (h[self.at[k] : self.at[k + 1]] for k in of)])
            wanted.append(least.ravel())
            codes = mix(least ^ SEEDS).ravel()  # a least hash and its permutation in one
            order = np.argsort(codes)
            self.by_size[size_class] = codes[order], np.repeat(of, len(SEEDS))[order].astype(np.int32)
        self.wanted = np.unique(np.concatenate(wanted))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.wanted & _U((1 << 20) - 1)).astype(np.int64)] = True

    def candidates(self, ordered: np.ndarray) -> set[int]:
        """Items that share a least hash with a window of a document's shingles in their order."""
        found: set[int] = set()
        hit = np.flatnonzero(np.isin(ordered, self.wanted))
        for u, (codes, of) in self.by_size.items():
            # Windows without any of the items' least shingles share none of their least hashes.
            for w in np.unique(np.concatenate([hit // u, np.maximum(hit // u - 1, 0)])):
                mixed = np.array([(mix(ordered[w * u : w * u + 2 * u] ^ seed)).min() for seed in SEEDS])
                low, high = np.searchsorted(codes, mixed), np.searchsorted(codes, mixed, "right")
                for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True):
                    found.update(of[a:b].tolist())
        return found

    def contained(self, ordered: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the document holds to CONTAINED at least."""
        out = []
        for k in sorted(self.candidates(ordered)):
            own = self.h[self.at[k] : self.at[k + 1]]
            shared = int(np.isin(own, ordered).sum())
            if 5 * shared >= 4 * len(own):
                out.append((k, shared))
        return out


def find_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", other_cols: tuple[str, ...] = ()) -> DataFrame:
    """(id, other_cols..., n_items, items array<struct<item, shared, size, containment>>) of each row of docs.

    An item is listed if the row's set of 5-word shingles holds 4/5 of the item's.  Words are lower-cased in A-Z; fewer
    than five words are one shingle.  Null and empty texts hold nothing and null or empty items are held by nothing;
    repeated items are listed each; an empty table on either side gives no items.  Items are read by the driver in
    parts of MOST_ITEM_BYTES of text and MOST_ITEMS, one at a time, each of which is broadcast and searched for.
    other_cols may name text_col, which then stays.
    """
    known = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter(F.length("text") > 0)
    kind = known.schema["item"].dataType
    others = [c for c in other_cols if c != text_col]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *others)
    ids, texts, size, more = [], [], 0, False
    for r in known.toLocalIterator():
        if ids and (size + len(r.text) > MOST_ITEM_BYTES or len(ids) >= MOST_ITEMS):
            rows, more = _search(rows, Items(ids, texts), kind, more), True
            ids, texts, size = [], [], 0
        ids.append(r.item)
        texts.append(r.text)
        size += len(r.text)
    rows = _search(rows, Items(ids, texts), kind, more).withColumnRenamed("__id", id_col).withColumn("n_items", F.size("items").cast("long"))
    return rows.withColumnRenamed("__text", text_col) if text_col in other_cols else rows.drop("__text")


def _search(rows: DataFrame, items: Items, kind: T.DataType, more: bool) -> DataFrame:
    """rows with what one part of the items adds to the column items."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    names = [c for c in rows.columns if c != "items"]
    schema = rows.select(names).schema.add("items", T.ArrayType(T.StructType().add("item", kind).add("shared", "long").add("size", "long").add("containment", "double")))

    def run(batches):
        it = shared.value
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            lists = batch.column(len(names)).to_pylist() if more else [[] for _ in range(batch.num_rows)]
            for a, b in slices(offsets):
                h, doc = ordered_shingles(*word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a)
                hit = np.flatnonzero(it.filter[(h & _U((1 << 20) - 1)).astype(np.int64)])
                hit = np.unique(doc[hit[np.isin(h[hit], it.wanted)]])
                for i, first, last in zip(hit.tolist(), np.searchsorted(doc, hit).tolist(), np.searchsorted(doc, hit, "right").tolist(), strict=True):
                    for k, n in it.contained(h[first:last]):
                        size = int(it.at[k + 1] - it.at[k])
                        lists[a + i].append({"item": it.ids[k], "shared": n, "size": size, "containment": n / size})
            target = pa.list_(pa.struct([("item", to_arrow_type(kind)), ("shared", pa.int64()), ("size", pa.int64()), ("containment", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(lists, target)], [*names, "items"])

    return rows.mapInArrow(run, schema)


def op7_contamination(spark, sf_dir: str) -> DataFrame:
    """The query: (doc_id, item_id, shared, size, containment) for all documents and all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("items").alias("x")).select("doc_id", F.col("x.item").alias("item_id"), "x.shared", "x.size", "x.containment")
