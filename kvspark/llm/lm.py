"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from kvspark.llm.common import materialize, mix, slices, text_bytes, word_hashes

_U = np.uint64
END, BEGIN = _U(0xE0D0E0D0E0D0E0D1), _U(0xB0B0B0B0B0B0B0B1)
#: Counts are kept as powers of this base, each n-gram under every level up to its own.
BASE = 1.5
#: Bits set for the first level of an n-gram, and for each further one.
FIRST, FURTHER = 8, 3
#: Bytes of one segment of a filter.
SEGMENT = 1 << 20
#: Bytes of segments that a task holds at once.
MOST_FILTER = 96 << 20
#: Words of text, of eight bytes each, for every part that n-grams are dealt to; one group counts a part's and answers for them.
MOST_WORDS = 1_000_000
#: Tokens of texts that ask for their n-grams together, each once; a longer text asks alone.
BLOCK = 1 << 20
#: Bits of a bigram's hash that choose its part; the others, 40, tell a part's bigrams apart.
DEAL = 24
#: Levels that counts of 64 bits can have.
LEVELS = 112
#: Share of the bigram estimate in a probability.
WEIGHT = 0.6


def levels(count: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log_BASE(count))."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def value(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 of level 0."""
    low = np.ceil(BASE ** (np.maximum(level, 1) - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.maximum(level, 1).astype(float) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


#: value() of every level.
VALUES = value(np.arange(LEVELS))


@dataclass
class Filter:
    """Bit segments by number; an n-gram lies in the segment that its hash names.  Missing segments hold nothing."""

    segments: int
    bits: int
    held: dict[int, np.ndarray]

    def places(self, h: np.ndarray, level: int, k: int) -> np.ndarray:
        return mix(h + _U((level * 16 + k) * 0x9E3779B97F4A7C15 % 2**64)) % _U(self.bits)

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(20)) % _U(self.segments)

    def fill(self, h: np.ndarray, level: np.ndarray) -> bytes:
        """The bits of n-grams of one segment."""
        out = np.zeros(self.bits, bool)
        top = 1
        while len(h):
            for k in range(FIRST if top == 1 else FURTHER):
                out[self.places(h, top, k)] = True
            top += 1
            h, level = h[level >= top], level[level >= top]
        return np.packbits(out, bitorder="little").tobytes()

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels found by probing 1, 2, ... until one is missing; and which n-grams fall into the segments held."""
        out, here = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        of = self.segment(h).astype(np.int32)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.array([*self.held, 0])[:-1]), np.searchsorted(of[order], np.array([*self.held, 0])[:-1], "right")
        for data, a, b in zip(self.held.values(), *cuts, strict=True):
            at = order[a:b]
            here[at] = True
            level = 1
            while at.size and level < LEVELS:
                for k in range(FIRST if level == 1 else FURTHER):
                    p = self.places(h[at], level, k)
                    at = at[(data[p >> _U(3)] >> (p & _U(7)).astype(np.uint8)) & 1 > 0]
                out[at] = level
                level += 1
        return out, here


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 10 == 0, F.lit(False))


def sequence(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (each text's words, then the end), and each text's number of them."""
    h, row = word_hashes(buf, offsets)
    count = np.bincount(row, minlength=len(offsets) - 1)
    return np.insert(h, np.cumsum(count), END), count + 1


def preceding(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each one, or the begin of its text."""
    before = np.concatenate([[BEGIN], tokens[:-1]])
    before[np.cumsum(lengths) - lengths] = BEGIN
    return before


def bigram(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9E3779B97F4A7C15) + token)


def dealt(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes by part and value, the place of each of h among them, and the cuts between parts."""
    own, of = np.unique(h, return_inverse=True)
    part = ((own & _U((1 << DEAL) - 1)) % _U(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return own[order], place[of], np.searchsorted(part[order], np.arange(parts + 1))


def _planes(cuts: np.ndarray, width: int) -> list[np.ndarray]:
    """Places of the first byte, the second, ... of the values from each cut to the next, laid plane after plane."""
    size = np.diff(cuts)
    first, step = np.arange(cuts[-1]) + np.repeat(cuts[:-1] * (width - 1), size), np.repeat(size, size)
    return [first + k * step for k in range(width)]


def blobs(values: np.ndarray, cuts: np.ndarray, width: int) -> pa.Array:
    """An Arrow binary column with the lower bytes of the values from each cut to the next, in planes, which compress well."""
    data, split = np.empty(len(values) * width, np.uint8), np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    for k, at in enumerate(_planes(cuts, width)):
        data[at] = split[:, k]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(data)])


def flat(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column that blobs() made, one row's after the other's, and the cuts between rows."""
    column = pa.chunked_array([c.cast(pa.large_binary()) for c in column.chunks], pa.large_binary()).combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    cuts = (at - at[0]) // width
    out = np.zeros((cuts[-1], 8), np.uint8)
    for k, place in enumerate(_planes(cuts, width)):
        out[:, k] = data[place]
    return out.view(np.uint64).ravel(), cuts


def look_up(h: np.ndarray, n: np.ndarray, segment: int, most: int) -> np.ndarray:
    """Levels that a filter of those of the distinct n-grams h that have a count says of all of them, most bytes at once."""
    held = n > 0
    level = levels(n[held])
    need = int((FIRST * len(level) + FURTHER * (level - 1).sum()) / np.log(2)) + 64
    segments = -(-need // (segment * 8))
    f = Filter(segments, -(-need // segments // 8) * 8, {})
    known, out = h[held], np.zeros(len(h), np.int64)
    of = f.segment(known)
    per = max(1, most // (f.bits // 8))
    for begin in range(0, segments, per):
        f.held = {k: np.frombuffer(f.fill(known[of == _U(k)], level[of == _U(k)]), np.uint8) for k in range(begin, min(begin + per, segments))}
        found, here = f.look_up(h)
        out[here] = found[here]
    return out


_ASKED = "block long, part int, words binary, word_n binary, pairs binary, pair_n binary, tokens binary, lengths binary, ids array<{}>"
_FIELDS = ["block", "part", "words", "word_n", "pairs", "pair_n", "tokens", "lengths", "ids"]


def asked(rows: DataFrame, parts: int) -> DataFrame:
    """Of rows (id, text, train) in blocks: distinct words and bigrams by part, with their times in training texts; and in
    a row with a part below 0 the texts as numbers of words, in compressed planes of bytes, with the words and the ids."""

    most = BLOCK

    def block(number, ids, tokens, lengths, train):
        word, of, cuts = dealt(tokens, parts)
        trained = np.repeat(train, lengths)
        pair, place, pair_cuts = dealt(bigram(preceding(tokens, lengths), tokens), parts)
        n, pair_n = (np.bincount(x[trained], minlength=len(y)).astype(np.uint32) for x, y in ((of, word), (place, pair)))
        some = pa.array((np.diff(cuts) > 0) | (np.diff(pair_cuts) > 0))
        cols = [pa.array(np.full(parts, number)), pa.array(np.arange(parts, dtype=np.int32)), blobs(word, cuts, 8), blobs(n, cuts, 4), blobs(pair >> _U(DEAL), pair_cuts, 5), blobs(pair_n, pair_cuts, 4)]
        none = [pa.nulls(parts, pa.binary()), pa.nulls(parts, pa.binary()), pa.nulls(parts, pa.list_(ids.type))]
        yield pa.RecordBatch.from_arrays([*cols, *none], _FIELDS).filter(some)
        common = np.argsort(-np.bincount(of, minlength=len(word)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(word), np.uint32)
        rank[common] = np.arange(len(word), dtype=np.uint32)
        planes = np.ascontiguousarray(rank[of].view(np.uint8).reshape(-1, 4).T)
        own = pa.array([-1 - number % 1_000_003], pa.int32())
        texts = [pa.array([x], pa.binary()) for x in (pa.compress(planes, "zstd", asbytes=True), lengths.tobytes())]
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([number]), own, pa.array([word[common].tobytes()], pa.binary()), *[pa.nulls(1, pa.binary())] * 3, *texts, listed], _FIELDS)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            train = batch.column(2).to_numpy(zero_copy_only=False)
            kept, first = [], 0
            for a, b in slices(offsets):
                kept.append(sequence(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                if b == len(offsets) - 1 or sum(len(x) for x, _ in kept) >= most:
                    tokens, lengths = (np.concatenate(x) for x in zip(*kept, strict=True))
                    yield from block(number, batch.column(0).slice(first, b - first), tokens, lengths, train[first:b])
                    kept, first, number = [], b, number + 1

    return rows.mapInArrow(run, _ASKED.format(rows.schema["id"].dataType.simpleString()))


def answered(asks: DataFrame) -> DataFrame:
    """asks with, for the n-grams of each row, the words' counts in words, their levels in word_n and the bigrams' in pairs;
    total, distinct and ends sum up to the numbers of training tokens, of different ones and of ends."""

    limits = SEGMENT, MOST_FILTER  # as the driver has them

    def run(key, table):
        if key[0].as_py() < 0:
            zero = pa.array(np.zeros(len(table), np.int64))
            return table.append_column("total", zero).append_column("distinct", zero).append_column("ends", zero)
        out = []
        for name, width in (("word", 8), ("pair", 5)):
            h, cuts = flat(table.column(f"{name}s"), width)
            own, of = np.unique(h, return_inverse=True)
            n = np.bincount(of, flat(table.column(f"{name}_n"), 4)[0], len(own)).astype(np.int64)
            out.append((own, n, n[of], look_up(own, n, *limits)[of].astype(np.uint8), cuts))
        (word, n, counts, level, cuts), (*_, pair_level, pair_cuts) = out
        sums = np.zeros((3, len(table)), np.int64)
        sums[:, 0] = n.sum(), (n > 0).sum(), n[word == END].sum()
        none = pa.nulls(len(table), pa.binary())
        said = [blobs(counts, cuts, 8), blobs(level, cuts, 1), blobs(pair_level, pair_cuts, 1), none, none, none]
        cols = [table.column("block"), table.column("part"), *said, pa.nulls(len(table), table.schema.field("ids").type), *map(pa.array, sums)]
        return pa.table(cols, names=[*_FIELDS, "total", "distinct", "ends"])

    kind = asks.schema["ids"].dataType.elementType.simpleString()
    return asks.groupBy("part").applyInArrow(run, _ASKED.format(kind) + ", total long, distinct long, ends long")


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, train_tokens, n_tokens, n_known, base_score, score) of each row, learning from the rows where train holds.

    score is the sum over a text's tokens of log10(0.6 * min(1, c(uv) / c(u)) + 0.4 * (c(v) + 0.1) / (N + 0.1 (V + 1)))
    with quantised counts of words and of bigrams, those seen once too; base_score has the exact counts of words alone.
    Texts are split once.  Blocks of them send each of their different n-grams to the part that it is dealt to; a part's
    group counts the training texts' ones, puts them into a filter and answers every block with what the filter says; a
    block's answers meet its texts in a last group.  Words are told apart by 64 bits of a hash, a part's bigrams by 40.  Nothing is sent around, and the driver gets three sums.
    Texts are read whole; null and empty ones are an end alone; without training rows every count is 0; an empty table
    gives an empty table; repeated rows and null ids stay rows of their own.  docs must give the same rows in the same
    order if a task runs again; if answers and texts of a block don't fit each other, the query fails.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + size // (8 * MOST_WORDS)
    found = materialize(answered(asked(rows, parts)))
    total, distinct, ends = found.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "ends"))).first()
    z, begin = total + 0.1 * (distinct + 1), float(max(ends, 1))

    def run(table):
        is_text = table.column("part").to_numpy() < 0
        text, said = table.filter(pa.array(is_text)), table.filter(pa.array(~is_text)).sort_by("part")
        word, lengths = (np.frombuffer(text.column(c)[0].as_buffer(), t) for c, t in (("words", np.uint64), ("lengths", np.int64)))
        tokens = np.frombuffer(pa.decompress(text.column("tokens")[0].as_buffer(), 4 * int(lengths.sum()), "zstd"), np.uint8)
        of = np.ascontiguousarray(tokens.reshape(4, -1).T).view(np.uint32).ravel()
        _, where, _ = dealt(word, parts)
        pair, place, _ = dealt(bigram(preceding(word[of], lengths), word[of]), parts)
        n, level, pair_level = (flat(said.column(c), w)[0].astype(np.int64) for c, w in (("words", 8), ("word_n", 1), ("pairs", 1)))
        if len(text) != 1 or len(n) != len(word) or len(pair_level) != len(pair):
            raise ValueError("a block's texts have changed between two runs of a task")
        n, level = n[where], level[where]
        start, count = np.cumsum(lengths) - lengths, VALUES[level]
        context = np.concatenate([[begin], count[of[:-1]]])
        context[start] = begin
        share = np.minimum(1.0, VALUES[pair_level[place]] / np.maximum(context, 1.0))
        p = np.log10(WEIGHT * share + (1 - WEIGHT) * ((count + 0.1) / z)[of])
        sums = [np.add.reduceat(x, start) for x in ((n > 0).astype(np.int64)[of], np.log10((n + 0.1) / z)[of], p)]
        ids = text.column("ids").combine_chunks().flatten()
        return pa.table([ids, *map(pa.array, (lengths, *sums))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    out = found.drop("total", "distinct", "ends").groupBy("block").applyInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), F.lit(int(total)).cast("long").alias("train_tokens"), "n_tokens", "n_known", "base_score", "score")


def op8_lm(spark, sf_dir: str) -> DataFrame:
    """The query: all documents, by a model of those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, ~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
