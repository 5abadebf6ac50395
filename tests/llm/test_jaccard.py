"""op2: the join against all pairs by brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd

from kvspark.llm.jaccard import jaccard_join, signatures


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    docs = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(docs).collect()}
    assert got == brute(rows)


def words(rng, n, most=5000):
    return [f"w{rng.randrange(most)}" for _ in range(n)]


def changed(rng, text, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text]


def test_families_and_shared_passages(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    texts = []
    for k in range(20):
        base = words(rng, rng.choice([3, 7, 12, 30, 80, 200, 500]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            texts.append(changed(rng, base, rng.choice([0, 0.005, 0.01, 0.03, 0.05])))
    for _ in range(120):  # documents that share a long passage, close to the threshold or far from it
        texts.append(words(rng, rng.choice([3, 10, 15, 20, 60])) + passage + words(rng, rng.choice([0, 2, 5])))
    texts += [changed(rng, passage * 4, 0.002) for _ in range(80)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t).replace("w1", "W1")) for i, t in enumerate(texts)]
    check(spark, [*rows, (9001, ""), (9002, None), (9003, " \t\n"), (9004, "One two"), (9005, "one  TWO"), (9006, "one")])


def test_families_without_their_base(spark):
    """Sets that are nearly, but not quite, similar enough, besides ones that are: buckets of many components."""
    rng = random.Random(6)
    texts = []
    for size in (40, 150, 400):
        base = words(rng, size)
        texts += [changed(rng, base, 0.022) for _ in range(25)] + [changed(rng, base, 0.035) for _ in range(25)]
    check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])


def test_repeated_and_null_ids_and_a_long_text(spark):
    rng = random.Random(7)
    a, b, c = (" ".join(words(rng, n)) for n in (50, 60, 60_000))
    rows = [(None, a), (3, a), (None, b), (5, c), (6, c + " end"), (8, a + " w1"), (8, b), (None, None), (7, "odd one out"), (None, "nobody else says this at all")]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = Counter({(None, 3): 2, (3, 3): 1, (8, 3): 2, (5, 5): 1, (6, 5): 1, (None, None): 2, (7, 7): 1})
    assert Counter((r.doc_id, r.component_id) for r in got) == want


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for n in (4, 7, 12, 17, 18, 25, 60, 300, 2000):
        for _ in range(30):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            gone = int(rng.integers(0, n // 5 + 1))
            new = rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)
            b = np.concatenate([a[gone:], new])
            both = n - gone
            if 9 * both < 4 * (n + len(b)):
                continue
            of, sig, tag, spare = signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([n, len(b)]))
            met = False
            for t in np.unique(tag):
                x, y = ((of == k) & (tag == t) for k in (0, 1))
                shared = set(sig[x].tolist()) & set(sig[y].tolist())
                if shared:
                    met = True
                    assert len(shared) > max(spare[x].max(), spare[y].max())
            assert met


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, key string, n int, sig int")
    assert jaccard_join(docs).collect() == []
    docs = spark.createDataFrame([(2, "a b c d e f", "x", 1, 1), (1, "a b c d e f", "y", 2, 2), (2, "a b c d e f", "x", 1, 1)], docs.schema)
    assert sorted(jaccard_join(docs).collect()) == [(1, 2, 1), (2, 2, 1), (2, 2, 1)]
