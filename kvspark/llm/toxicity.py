"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kvspark.llm.common import _LOWER, mix, prefix_sums, range_hash, slices, split_words, text_bytes

#: Bounds of the sample of labelled rows that the classifier is fitted on: rows of each label, and bytes of their texts;
#: where the texts are longer, there are fewer of them.
MOST_ROWS = {1: 2000, 0: 3000}
MOST_BYTES = 16 << 20
#: Follows each window, so that matches in it end well before the input does and tiny blocks are still compressed.
PAD = b"~0|1|2|3|4|5|6|7~"
#: Longer words are several windows.
WINDOW = 64
#: Bytes by which a window has to be shorter with the toxic dictionary to count; fitting chooses one.
THRESHOLDS = (1, 2, 3, 4)


@dataclass(frozen=True)
class Model:
    """Contents of both dictionaries and the calibration of a text's window statistics."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    threshold: int = 2
    level: int = 9

    def distances(self, words: list[bytes]) -> np.ndarray:
        """For each word, by how many bytes less its windows take with the toxic dictionary than with the ordinary one."""
        begin, windows = [], []
        for w in words:
            begin.append(len(windows))
            parts = [w] if len(w) <= WINDOW else [w[k : k + WINDOW] for k in range(0, len(w), WINDOW * 3 // 4)]
            windows += [b" " + p + b" " + PAD for p in parts]
        if not windows:
            return np.zeros(0)
        plain, toxic = (self._lengths(d, windows) for d in (self.ordinary, self.toxic))
        return np.maximum.reduceat(plain - toxic, begin).astype(float)

    def _lengths(self, content: bytes, windows: list[bytes]) -> np.ndarray:
        """Bytes that each window takes with a dictionary of this content."""
        known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        made = zstd.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        return np.fromiter((len(x) for k in range(0, len(windows), 50_000) for x in made.multi_compress_to_buffer(windows[k : k + 50_000])), np.int64, len(windows))

    def windows(self, column: pa.Array):
        """(first row, end row, row of each window, its distance) of slices of texts."""
        buf, offsets = text_bytes(column)
        for a, b in slices(offsets):
            low = _LOWER[buf[offsets[a] : offsets[b]]]
            start, end, row = split_words(low, offsets[a : b + 1] - offsets[a])
            if len(start):
                _, first, of = np.unique(range_hash(prefix_sums(low), start, end), return_index=True, return_inverse=True)
                data = low.tobytes()
                yield a, b, row, self.distances([data[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])[of]

    def statistics(self, rows: int, windows) -> np.ndarray:
        """Of each text: largest distance, log of the number of windows that reach the threshold and of all windows, and 1."""
        out = np.zeros((rows, 4))
        out[:, 3] = 1
        for a, b, row, d in windows:
            largest = np.zeros(b - a)
            np.maximum.at(largest, row, d)
            out[a:b, 0] = np.minimum(largest, 8)
            out[a:b, 1] = np.log1p(np.bincount(row[d >= self.threshold], minlength=b - a))
            out[a:b, 2] = np.log1p(np.bincount(row, minlength=b - a))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.statistics(len(column), self.windows(column)) @ np.array(self.weights), -30, 30))) if self.weights else np.zeros(len(column))


def _bags(texts: list[str]) -> list[set[bytes]]:
    """Sets of the lower-cased words of texts, one of texts that look like copies: which share a least hash of their rarer words."""
    bags = [{w for w in t.encode().translate(bytes(_LOWER)).split()} for t in texts]
    seen_in = Counter(w for b in bags for w in b)
    common = {w for w, c in seen_in.items() if c > max(3, 0.02 * len(bags))}
    seen, out = set(), []
    for b in bags:
        rare = np.array([crc32(w) for w in (b - common or b)] or [0], np.uint64)
        marks = {(k, int(mix(rare ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min())) for k in range(3)}
        if not marks & seen:
            out.append(b)
        seen |= marks
    return out


def dictionaries(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> tuple[bytes, bytes]:
    """Contents: windows that recur in many texts of a class, the commonest last, which is nearest to the input.

    The toxic one has, besides, words and word beginnings that 1.5 % of the toxic texts have, 20 times the share that
    the ordinary texts have; what both kinds of text use lies at the same place in both, so it costs the same.
    """
    def count(bags):
        return Counter(x for b in bags for w in b for x in {(w, b" "), *((w[:k], b"") for k in (4, 5, 6) if len(w) > k)})

    in_toxic, in_ordinary = count(toxic), count(ordinary)
    known = sorted(((c, w) for w, c in in_ordinary.items() if c >= max(3, 0.02 * len(ordinary))), reverse=True)
    special = sorted(((c, w) for w, c in in_toxic.items() if c >= max(4, 0.015 * len(toxic)) and (in_ordinary[w] + 0.5) / len(ordinary) * 20 < c / len(toxic)), reverse=True)
    content = lambda found: b"".join(b" " + w + tail for _, (w, tail) in reversed(found))
    base = content(known) + b" " + PAD
    return content(special) + base, base


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.01] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit_texts(texts: list[str], labels: list[int]) -> Model:
    """Fits on texts in a fixed order: two of three by hash give the dictionaries, the others the thresholds; all do both if they are few."""
    order = range(len(texts))
    of = lambda y, part: [texts[i] for i in order if labels[i] == y and part(i)]
    if not of(1, lambda i: True) or not of(0, lambda i: True):
        return Model(b"", b"", ())
    few = sum(labels) < 60
    third = [crc32(t.encode()) % 3 == 0 for t in texts]
    toxic, ordinary = dictionaries(*(_bags(of(y, lambda i: few or not third[i])) for y in (1, 0)))
    held = [i for i in order if few or third[i]]
    column, y = pa.array([texts[i] for i in held], pa.string()), np.array([labels[i] for i in held], float)
    windows = list(Model(toxic, ordinary, ()).windows(column))
    best, fitted = np.inf, None
    for threshold in THRESHOLDS:  # that by which the held texts are told apart best
        x = Model(toxic, ordinary, (), threshold).statistics(len(held), windows)
        weights = calibrate(x, y)
        loss = np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ np.array(weights))).mean()
        if loss < best:
            best, fitted = loss, Model(toxic, ordinary, weights, threshold)
    return fitted


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on a sample of labelled rows outside the held-out fold, at most MOST_ROWS of each label by hash of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    ids = None
    for label, most in MOST_ROWS.items():
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    texts = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    # At most the sample's few thousand rows come to this window, and of these as many as the bytes allow to the driver.
    size = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = sorted((r.id, r.label, r.text) for r in texts.withColumn("bytes", size).filter(F.col("bytes") <= MOST_BYTES // 2).collect())
    return fit_texts([r[2] for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, between 0 and 1: the higher, the likelier toxic.

    Null and empty texts have no windows and get the score of none; words of any length are scored whole; without
    both labels in the sample every score is 0; an empty table gives an empty table.  A column of docs that is named
    like score_col is replaced.
    """
    kept = [c for c in docs.columns if c != score_col]
    schema = docs.select(kept).schema.add(score_col, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most some 100 kB

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column(kept.index(text_col))))], [*kept, score_col])

    return docs.select(kept).mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The query: all documents, scored by a model of the labelled rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
