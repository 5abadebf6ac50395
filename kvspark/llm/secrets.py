"""Secret scan: a trigram inverted index proposes documents for each rule, the rule's pattern confirms them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from re import _constants as C
from re import _parser

from kvspark.llm.common import slices, text_bytes

#: Sets of strings larger than this are given up when a pattern is read: the query then only gets weaker.
MOST_STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern and, where given, what a match must fulfil besides."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    compiled: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII))

    def spans(self, text: str):
        """(start, end) of the leftmost matches that don't overlap, without those whose group is too short."""
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.start(), m.end()


#: Kinds in the order in which they are listed in a result.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the maximal runs of [0-9a-f] that are long enough
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

Query = tuple  # ("all", q...) | ("any", q...) | a folded trigram; ("all",) holds always


def _both(kind: str, parts) -> Query:
    flat = []
    for p in parts:
        flat += p[1:] if isinstance(p, tuple) and p[0] == kind else [p]
    flat = list(dict.fromkeys(flat))
    if kind == "any" and ("all",) in flat:
        return ("all",)
    return flat[0] if len(flat) == 1 else (kind, *flat)


def _grams(strings) -> Query:
    """What holds in a text that has one of the strings."""
    return _both("any", [_both("all", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else ("all",)


def _walk(items) -> tuple[list[Query], set[str] | None]:
    """Queries that any match fulfils, and the strings it can be, lower-cased, where they are few."""
    queries, run = [], {""}

    def flush():
        nonlocal run
        if run:
            queries.append(_grams(run))
        run = {""}

    exact = True
    for op, arg in items:
        own: set[str] | None = None
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 6:
            own = {chr(v).lower() for _, v in arg}
        elif op is C.SUBPATTERN:
            q, own = _walk(arg[3])
            queries += q if own is None else []
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for _, s in parts):
                own = set().union(*(s for _, s in parts))
            else:
                queries.append(_both("any", [_both("all", q + ([_grams(s)] if s is not None else [])) for q, s in parts]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            q, strings = _walk(inner)
            if strings is not None and high <= 1:
                own = strings | ({""} if low == 0 else set())
            elif low >= 1:
                queries += q + ([_grams(strings)] if strings is not None else [])
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, own)}
        else:
            flush()
            exact = False
            if own is not None and len(own) <= MOST_STRINGS:
                run, exact = own, False
    if exact:
        return queries, run
    flush()
    return queries, None


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-cased trigrams that every text with a match fulfils; ("all",) if there is none."""
    queries, strings = _walk(_parser.parse(pattern))
    return _both("all", [q for q in [*queries, *([_grams(strings)] if strings is not None else [])] if q != ("all",)])


def vocabulary(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*(vocabulary(q) for q in query[1:])) if len(query) > 1 else set()


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 32


class Index:
    """Postings of a block of documents: for each trigram that some rule asks for, the documents that have it.

    Each task indexes the documents it reads, so postings are never shuffled and no list is longer than a block.
    """

    def __init__(self, grams: list[str]):
        self.grams = {g: k for k, g in enumerate(grams)}
        self.number = np.full(1 << 24, -1, np.int16)
        for g, k in self.grams.items():
            a, b, c = g.encode("latin-1")
            self.number[a << 16 | b << 8 | c] = k

    def postings(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(offsets) - 1
        low = _FOLD[buf]
        if len(low) < 3:
            return [np.zeros(0, np.int64)] * len(self.grams)
        found = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found >= 0)
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at + 3 <= offsets[row + 1]
        pairs = np.unique(found[at[whole]].astype(np.int64) * n + row[whole])
        cut = np.searchsorted(pairs, np.arange(len(self.grams) + 1) * n)
        return [pairs[a:b] % n for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def answer(self, query: Query, lists: list[np.ndarray], n: int) -> np.ndarray:
        if isinstance(query, str):
            return lists[self.grams[query]]
        if query == ("all",):
            return np.arange(n)
        parts = [self.answer(q, lists, n) for q in query[1:]]
        out = parts[0]
        for p in sorted(parts[1:], key=len):
            out = np.intersect1d(out, p, True) if query[0] == "all" else np.union1d(out, p)
        return out


def scanner(rules: tuple[Rule, ...]):
    """A function of a string column that gives the spans (start, end, place of the rule) of each row, in order."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = Index(sorted(set().union(*map(vocabulary, queries))))

    def scan(column: pa.Array) -> list[list[tuple[int, int, int]]]:
        buf, offsets = text_bytes(column)
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        for a, b in slices(offsets, 4 << 20):
            at = offsets[a : b + 1] - offsets[a]
            part = buf[offsets[a] : offsets[b]]
            lists = index.postings(part, at)
            texts: dict[int, str] = {}
            for k, rule in enumerate(rules):
                for row in index.answer(queries[k], lists, b - a).tolist():
                    if row not in texts:
                        texts[row] = part[at[row] : at[row + 1]].tobytes().decode("utf-8", "replace")
                    out[a + row] += [(s, e, k) for s, e in rule.spans(texts[row])]
        for spans in out:
            spans.sort(key=lambda x: (x[0], x[2]))
        return out

    return scan


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) for each row: all spans by start, then by the order of rules.

    Positions are code points, ends exclusive.  Null and empty texts have no spans; null ids and repeated rows are
    rows like others; an empty table gives an empty table; other columns of docs are not read.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>"
    kinds = [r.kind for r in rules]

    def run(batches):
        scan = scanner(rules)
        for batch in batches:
            found = scan(batch.column(1))
            spans = pa.array([[{"kind": kinds[k], "start": s, "end": e} for s, e, k in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["id", "spans"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text_col put out by mark; overlapping spans get one mark.  Null texts stay null."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        scan = scanner(rules)
        for batch in batches:
            k = names.index(text_col)
            texts = batch.column(k).to_pylist()
            for i, spans in enumerate(scan(batch.column(k))):
                if spans:
                    kept, end = [], 0
                    for start, stop, _ in spans:
                        if start >= end:
                            kept += [texts[i][end:start], mark]
                        end = max(end, stop)
                    texts[i] = "".join(kept) + texts[i][end:]
            cols = list(batch.columns)
            cols[k] = pa.array(texts, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """The query: all documents; base kinds are counted and digested, spans has every kind."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["kind"].isin(*(r.kind for r in BASE)))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
