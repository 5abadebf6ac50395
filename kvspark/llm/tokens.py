"""Token counts of a byte-pair vocabulary by a compiled finite-state transducer.

A byte-pair encoding is the one segmentation whose neighbouring tokens each encode alone as that pair.  So the last
token of every prefix of a text, and with it the count, follows from the last tokens at the few places behind from
which a token can still be under way: a finite state.  Each transition carries the number of tokens it adds.  States
are numbered as they are first met; a table from (state, symbol) to (state, tokens) is all that is read after that.
Texts are cut in chunks that run side by side through the table.  A chunk's state map is constant after its first
symbol that no token can cross; before it, the map is that of the few symbols of its head.  Maps are evaluated for
all chunks at once, for the states that the chunks before end in, until these agree along each text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from kvspark.llm.common import SLICE_BYTES

#: Symbols in a chunk: one lane of the table walk.
CHUNK = 256
#: States after which a worker's transducer starts anew; bounds its memory, never the result.
MOST_STATES = 200_000
SPACE = "▁"


class Vocabulary:
    """Pieces of a sentencepiece byte-pair model with byte fallback, and which pairs of them can stand side by side."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        self.prefixes = {p[:k] for p in self.rank for k in range(1, len(p) + 1)}
        self.symbols = sorted({c for p in self.rank for c in p})
        #: When a piece is made: its rank, before all if it is one sign.
        self.made = {c: -1.0 for c in self.symbols} | {p: r for p, r in self.rank.items() if len(p) > 1}
        self.split: dict[str, tuple[str, str] | None] = {}
        crossing = {(a, b) for p in self.rank for a, b in zip(p, p[1:], strict=False)}
        #: A space sign after another sign starts anew if no piece has it inside; so does a sign outside the vocabulary.
        self.breaks = not any(b == SPACE and a != SPACE for a, b in crossing)

    def encode(self, text: str) -> list[str]:
        """Merges the best pair, the leftmost of equals, until none is a piece."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a text and the last pair that was merged."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == np.inf:
                break
            last = (parts[best[1]], parts[best[1] + 1])
            parts[best[1] : best[1] + 2] = ["".join(last)]
        return parts, last

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that a longer one is merged from; None if it doesn't encode as itself."""
        if piece not in self.split:
            parts, last = self._merge(piece)
            self.split[piece] = last if parts == [piece] else None
        return self.split[piece]

    def alone(self, piece: str) -> bool:
        """Whether the piece encodes as itself."""
        return len(piece) == 1 or self.halves(piece) is not None

    def fits(self, a: str, b: str) -> bool:
        """Whether two pieces that encode as themselves stay as they are side by side.

        Undoes the later merge of the two at their border, again and again: no piece across the border may have come
        before it, or at the same rank to its left.  Where a piece's halves don't come before it, all is merged anew.
        """
        first, second, latest, ties = a, b, np.inf, False
        rank, made, split = self.rank, self.made, self.split
        while True:
            across = rank.get(a + b)
            if across is not None and (across < latest or ties and across == latest):
                return False
            when_a, when_b = made[a], made[b]
            ties = when_a <= when_b
            latest = when_b if ties else when_a
            if latest < 0:
                return True
            later = b if ties else a
            halves = split[later] if later in split else self.halves(later)
            if halves is None or made[halves[0]] >= latest or made[halves[1]] >= latest:
                return self.encode(first + second) == [first, second]
            a, b = (a, halves[0]) if ties else (halves[1], b)


class Transducer:
    """States: for each place from which a token may be under way, what it has read, which tokens can follow, the count before it.

    Counts are relative to the newest place, so a state doesn't grow with the text; a place that no token can leave any
    more is dropped, and last tokens that leave the same choice are one.  Transitions lie in one open-addressed table.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.code = {c: k + 1 for k, c in enumerate(vocabulary.symbols)}  # 0: any other sign
        self.width = len(self.code) + 1
        self.symbol_of = np.zeros(0x110000, np.int16)
        self.symbol_of[[ord(c) for c in self.code]] = list(self.code.values())
        self.symbol_of[0x20] = self.code[SPACE]
        self.states = [(("", "", 0),)]  # the first: nothing read that matters
        self.number = {self.states[0]: 0}
        self.below: dict[str, list[str]] = {}
        for p in vocabulary.rank:
            for k in range(1, len(p)):
                self.below.setdefault(p[:k], []).append(p)
        self.choices: dict[tuple[str, str], tuple | str | None] = {}
        self.used = 0
        self._room(1 << 16)

    def _room(self, n: int, old: tuple = ()) -> None:
        self.keys = np.full(n, -1, np.int64)
        self.to, self.adds = np.zeros(n, np.int32), np.zeros(n, np.int32)
        if old:
            keys, to, adds = (x[old[0] >= 0] for x in old)
            slot = self._slot(keys)
            todo = np.arange(len(keys))
            while todo.size:  # of those that meet in a slot, the last one written stays and the others go on
                free = self.keys[slot[todo]] < 0
                self.keys[slot[todo[free]]] = keys[todo[free]]
                done = self.keys[slot[todo]] == keys[todo]
                self.to[slot[todo[done]]], self.adds[slot[todo[done]]] = to[todo[done]], adds[todo[done]]
                todo = todo[~done]
                slot[todo] = (slot[todo] + 1) & (n - 1)

    def _slot(self, keys):
        return ((keys * 0x9E3779B1) >> 7) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; of those that aren't there, -1."""
        slot = self._slot(keys)
        odd = np.flatnonzero(self.keys[slot] != keys)
        while odd.size:
            empty = self.keys[slot[odd]] < 0
            slot[odd[empty]] = -1
            odd = odd[~empty]
            slot[odd] = (slot[odd] + 1) & (len(self.keys) - 1)
            odd = odd[self.keys[slot[odd]] != keys[odd]]
        return slot

    def _choice(self, read: str, last: str):
        """What tells last tokens apart after read: the tokens that may still follow, or the last token where these are many."""
        key = (read, last)
        if key not in self.choices:
            tokens = self.below.get(read, ())
            out: tuple | str | None = last
            if len(tokens) <= 16:
                out = tuple(t for t in tokens if self.v.alone(t) and (not last or self.v.fits(last, t))) or None
            self.choices[key] = out
        return self.choices[key]

    def step(self, state: int, symbol: int) -> None:
        """Adds one transition."""
        c = self.v.symbols[symbol - 1]
        places = self.states[state]
        last = places[-1][1]
        if c == SPACE and self.v.breaks and last and last[-1] != SPACE:
            places = self.states[0]  # no token crosses: what came before no longer matters
        live, best = [], None
        for read, follow, count in places:
            grown = read + c
            if grown in self.v.prefixes and (not isinstance(follow, tuple) or any(t.startswith(grown) for t in follow)):
                if best is None and grown in self.v.rank and (grown in follow if isinstance(follow, tuple) else self.v.alone(grown) and (not follow or self.v.fits(follow, grown))):
                    best = (grown, count + 1)
                if isinstance(follow, tuple):
                    follow = tuple(t for t in follow if t != grown and t.startswith(grown)) or None
                else:
                    follow = self._choice(grown, follow)
                if follow is not None:
                    live.append((grown, follow, count))
        if best is None:
            raise ValueError(f"no segmentation ends at {c!r}")
        target = (*((r, t, n - best[1]) for r, t, n in live), ("", best[0], 0))
        if target not in self.number:
            self.number[target] = len(self.states)
            self.states.append(target)
        if 2 * (self.used + 1) > len(self.keys):
            self._room(2 * len(self.keys), (self.keys, self.to, self.adds))
        key = np.array([state * self.width + symbol])
        slot = int(self._slot(key)[0])
        while self.keys[slot] >= 0:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.to[slot], self.adds[slot] = key[0], self.number[target], best[1]
        self.used += 1

    def move(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and added tokens of lanes."""
        keys = state.astype(np.int64) * self.width + symbol
        slot = self.find(keys)
        if (new := np.flatnonzero(slot < 0)).size:
            for x in np.unique(keys[new]).tolist():
                self.step(x // self.width, x % self.width)
            slot = self.find(keys)
        return self.to[slot], self.adds[slot]

    def walk(self, symbols: np.ndarray, other: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs lanes over symbols[start : start + length] side by side; gives their last states and token counts.

        other: tokens that each sign outside the vocabulary makes; such a sign leads back to the first state.
        """
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        now, count = state[order].astype(np.int32), np.zeros(len(order), np.int64)
        for k in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -k, "left"))
            at = start[:n] + k
            s = symbols[at]
            known = np.flatnonzero(s > 0)
            if len(known) == n:
                now[:n], add = self.move(now[:n], s)
            else:
                add = other[at].astype(np.int32)
                to = np.zeros(n, np.int32)
                to[known], add[known] = self.move(now[:n][known], s[known])
                now[:n] = to
            count[:n] += add
        out_state, out_count = np.empty_like(now), np.empty_like(count)
        out_state[order], out_count[order] = now, count
        return out_state, out_count

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        said = [SPACE + t for t in texts if t]  # the model puts a space before a text that isn't empty
        found = np.zeros(len(texts), np.int64)
        if not said:
            return found
        points = np.frombuffer("".join(said).encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[points]
        other = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in said])])
        # Chunks, each of one text.
        per = -(-np.diff(offsets) // CHUNK)
        doc = np.repeat(np.arange(len(said)), per)
        begin = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * CHUNK
        end = np.minimum(begin + CHUNK, offsets[1:][doc])
        # The first sign of a chunk that no token crosses; a text's first chunk starts with one.
        space = symbols == self.code[SPACE]
        stop = symbols == 0
        if self.v.breaks:
            stop[1:] |= space[1:] & ~space[:-1]
        stop[offsets[:-1]] = True
        stops = np.flatnonzero(stop)
        first = np.minimum(np.append(stops, len(symbols))[np.searchsorted(stops, begin)], end)
        state, body = self.walk(symbols, other, first, end - first, np.zeros(len(doc), np.int32))
        fixed = first < end  # the map's value doesn't depend on where it starts
        # A map whose value depends on where it starts is evaluated for the state that the chunk before ends in, first for
        # what that is without any head, then again for those whose entry state has changed, all side by side, until
        # maps and entry states agree along every text.  Maps soon forget where they start, so few rounds are needed.
        heads = np.flatnonzero(first > begin)
        entry, head = np.full(len(doc), -1, np.int64), np.zeros(len(doc), np.int64)
        while True:
            todo = heads[entry[heads] != state[heads - 1]]
            if not todo.size:
                break
            entry[todo] = state[todo - 1]
            out, head[todo] = self.walk(symbols, other, begin[todo], first[todo] - begin[todo], state[todo - 1])
            state[todo] = np.where(fixed[todo], state[todo], out)
        total = body + head
        found[[i for i, t in enumerate(texts) if t]] = np.bincount(doc, total, len(said)).astype(np.int64)
        return found


@lru_cache(maxsize=2)
def _vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


_COMPILED: dict[bytes, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The transducer of a Python worker, which grows over its tasks until it has MOST_STATES."""
    if model not in _COMPILED or len(_COMPILED[model].states) > MOST_STATES:
        _COMPILED.clear()
        _COMPILED[model] = Transducer(_vocabulary(model))
    return _COMPILED[model]


def count_tokens(docs: DataFrame, model: bytes, *, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """docs with count_col: tokens of the whole text under a sentencepiece byte-pair model with byte fallback.

    Null and empty texts have none; texts of any length are counted whole; a column of docs that is named like
    count_col is replaced; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c != count_col]
    schema = docs.select(kept).schema.add(count_col, "long")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary's file

    def run(batches):
        for batch in batches:
            column, counts, a = batch.column(kept.index(text_col)), [], 0
            size = np.cumsum(np.array(pa.compute.binary_length(column).fill_null(0), np.int64)) if len(column) else []
            while a < len(column):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE_BYTES, "right")))
                counts.append(compiled(shared.value).count([t or "" for t in column.slice(a, b - a).to_pylist()]))
                a = b
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], [*kept, count_col])

    return docs.select(kept).mapInArrow(run, schema)


def read_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The bytes of a public vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    """The query: all documents under piece_bpe_32k.model."""
    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), read_model())
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
