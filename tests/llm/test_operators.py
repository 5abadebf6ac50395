"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kvspark.llm import contamination, lm, mixing, secrets, substrings, tokens, toxicity, vectors, warc
from kvspark.llm.common import components

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = word_list(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root[x] == r for x, r in got.items()) and {x for x, r in root.items() if x != r} <= set(got)


# 1


def test_toxicity(spark):
    rng = random.Random(3)
    plain, bad = [f"plain{i}" for i in range(60)], ["zarkhole", "grubface", "snotwit"]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (rng.choices(bad, k=2) if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame(pd.DataFrame([(i, t) for i, t, _ in rows], columns=["doc_id", "text"]))
    labels = spark.createDataFrame(pd.DataFrame([(i, y) for i, _, y in rows], columns=["doc_id", "toxic"]))
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert right / len(rows) > 0.95
    odd = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (1, None, 0.5), (2, "zarkhole " * 50_000, 0.5)], "doc_id long, text string, score double")
    found = toxicity.score(odd, model).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 for r in found) and found[0].score == found[1].score == found[2].score
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_distances_are_differences_of_compressed_lengths():
    import zstandard as zstd

    rng = random.Random(4)
    plain, bad = [f"plain{i}" for i in range(1500)], ["zarkhole", "grubface", "snotwit"]
    labels = [int(i % 3 == 0) for i in range(300)]
    model = toxicity.fit_texts([" ".join(rng.choices(plain, k=30) + rng.choices(bad, k=2 * y)) for y in labels], labels)
    assert model.threshold in toxicity.THRESHOLDS

    def size(content, word):
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        return len(zstd.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b" " + word + b" " + toxicity.PAD))

    words = [w.encode() for w in [*plain, *bad, "unseen"]]
    assert model.distances(words).tolist() == [size(model.ordinary, w) - size(model.toxic, w) for w in words]
    assert min(model.distances([w.encode() for w in bad])) >= model.threshold > max(model.distances([w.encode() for w in plain]))


def test_held_out_is_never_null(spark):
    ids = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long")
    import zlib

    assert {r.doc_id: r.h for r in ids.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()} == {None: False, 1: zlib.crc32(b"1") % 5 == 0, 2: zlib.crc32(b"2") % 5 == 0}


# 3


def test_secrets_against_plain_scan(spark):
    rng = random.Random(4)
    parts = ["Password: ", "api_key='", "TOKEN = ", "AKIA", "0123456789abcdef", "deadbeef", "A1B2C3D4E5F6G7H8", "paéss ", "secret=", "abcdefghijkl", "\n", '"', "-----BEGIN RSA PRIVATE KEY-----", "toKen:abcdefghijklmnop"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(400)] + [None, "", "password=" + "x" * 100_000]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "spans": 1, "kind": "k"}))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(docs).collect()}
    order = [r.kind for r in secrets.BASE + secrets.MORE]
    for i, t in enumerate(texts):
        want = [(r.kind, m.start(), m.end()) for r in secrets.BASE + secrets.MORE for m in r.compiled.finditer(t or "") if m.end(r.group) - m.start(r.group) >= r.least]
        assert got[i] == sorted(want, key=lambda x: (x[1], order.index(x[0])))
    kept = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert kept[len(texts) - 1] == "[SECRET]" and kept[len(texts) - 3] is None and kept[len(texts) - 2] == ""
    assert secrets.trigram_query(r"[0-9a-f]{16,}") == ("all",)
    assert secrets.find_secrets(docs.limit(0)).count() == 0


# 4


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "w " * rng.choice([0, 1, 5, 50, 700])) for i in range(600)] + [(7, "a", "x y")] * 3 + [(None, "b", "q"), (9999, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    found = mixing.pareto_mix(docs).collect()
    assert len(found) == len(rows)
    size = Counter()
    for r in rows:
        size[r[1]] += len((r[2] or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while True:
        left, free = total - sum(fixed.values()), [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3.0 * size[s] for s in over}
    target = fixed | share
    taken = Counter()
    for r in found:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, mixing.pareto_mix(docs).collect())) == sorted(map(str, found))
    assert mixing.pareto_mix(docs.limit(0)).count() == 0


def test_mix_draws_by_inclusion_odds(spark):
    """Over many seeds, each document is drawn as often as its inclusion probability says."""
    rng = random.Random(8)
    sizes = [rng.choice([1, 4, 9, 100]) for _ in range(600)] + [9000]
    docs = spark.createDataFrame([(i, "a", "w " * n) for i, n in enumerate(sizes)] + [(1000 + i, "b", "w " * 200) for i in range(300)], "doc_id long, source string, text string").cache()
    times, runs = Counter(), 6
    for seed in range(runs):
        found = mixing.pareto_mix(docs, weights=(1, 5), seed=seed).filter("source = 'a'").collect()
        for r in found:
            times[r.doc_id] += (r.taken - r.copies * r.size) / r.size
        rest = round(found[0].target) - found[0].copies * found[0].source_size
    low, high = 0.0, 10.0
    for _ in range(100):  # the slope at which the expected words are what is lacking
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, mid * n**0.5) * n for n in sizes) < rest else (low, mid)
    for n in (1, 4, 9, 100):
        own = [i for i, k in enumerate(sizes) if k == n]
        p, k = min(1, low * n**0.5), len(own) * runs
        assert abs(sum(times[i] for i in own) / k - p) < 4 * (p * (1 - p) / k) ** 0.5 + 0.03


# 5


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 32))
    x = [base[k % 40] + rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.2]) for k in range(300)]
    x += [x[0], x[0] * 2]
    rows = [(i, [float(np.float32(e)) for e in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [1.0, None] + [0.0] * 30), (904, [float("nan")] * 32), (905, [1.0, 2.0]), (906, [3.0] * 5), (907, [0.0] * 4 + [float('inf')])]
    short = [(950, [1.0, 1.1, 0.9]), (951, [1.0, 1.0, 1.0]), (952, [1e-30, 1e-30, 1.05e-30])]
    df = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<float>").withColumn("class", F.lit("x"))
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    u = np.array([np.float32(v) for _, v in rows]).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = sum(got[i].n_links for i in range(len(u)))
    assert found <= near.sum() and found >= 0.9 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(len(u)))
    root = list(range(len(u)))
    for _ in range(len(u)):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(u))]
    assert all(got[i].component_id >= root[i] for i in range(len(u))) and sum(got[i].component_id == root[i] for i in range(len(u))) >= 0.9 * len(u)
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i, _ in odd)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert all(got[i].component_id == 950 and got[i].n_links == 2 for i, _ in short)
    assert vectors.near_vectors(df.limit(0)).count() == 0


# 6


def brute_repeats(texts, length=400):
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        flag = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                flag[i : i + length] = True
        flag = flag[: len(d)]
        runs = int((np.diff(np.concatenate([[0], flag.astype(int)])) > 0).sum())
        out.append((len(d), int(flag.sum()), runs, hashlib.sha256(bytes(b for b, f in zip(d, flag, strict=True) if not f)).hexdigest()))
    return out


def test_substrings_against_all_windows(spark):
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    p, q = noise(700), noise(390)
    texts = [noise(50) + p + noise(30), p[100:650], p, p, noise(10) + q + "!", q + "?", "a" * 1500, "ab" * 450, None, "", noise(900)]
    texts += [noise(rng.randrange(200)) + p[rng.randrange(100) : rng.randrange(450, 700)] + noise(5) for _ in range(70)]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "anchor": 1})).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def test_substrings_behind_sixteen_mib(spark):
    rng = np.random.default_rng(11)
    noise = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    p, head = noise(900), noise((1 << 24) + 5000)
    for at in (len(head), (1 << 20) - 300):
        text = head[:at] + p + head[at:]
        docs = spark.createDataFrame([(1, text), (2, "!" + p + "?"), (3, noise(900))], "doc_id long, text string")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup_substrings(docs).collect()}
        want = [(1, text, head), (2, "!" + p + "?", "!?")]
        assert {k: got[k] for k in (1, 2)} == {k: (len(t), 900, 1, hashlib.sha256(rest.encode()).hexdigest()) for k, t, rest in want}
        assert got[3][1] == 0


def test_substrings_repeated_in_a_group():
    rng = random.Random(5)
    for _ in range(200):
        length, letters = rng.choice([1, 2, 5, 8, 13, 14, 40]), rng.sample(range(256), rng.choice([1, 2, 20, 256]))
        parts = [bytes(rng.choices(letters, k=rng.choice([1, 3, 30, 90]))) for _ in range(rng.randrange(1, 8))]
        parts += [p[rng.randrange(len(p)) :] + bytes(rng.choices(letters, k=3)) for p in parts]
        times = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [i + length <= len(p) and times[p[i : i + length]] > 1 for p in parts for i in range(len(p) + 1)]
        assert substrings.repeated(parts, length).tolist() == want


def test_substrings_phrases_share_no_anchor():
    rng = np.random.default_rng(12)
    noise = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    phrases = [noise(100) for _ in range(30)]
    texts = [b"".join(noise(40) + p for p in phrases) for _ in range(2)]
    anchors = [set(substrings.window_runs(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1].tolist()) for t in texts]
    assert anchors[0] and not anchors[0] & anchors[1]  # no string of 400 bytes repeats, so nothing is gathered


# 7


def test_contamination_against_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 5, 9, 30, 120, 400])))) for k in range(40)] + [(90, None), (91, ""), (0, "two rows")]
    docs = []
    for i in range(200):
        w = rng.choices(vocab, k=rng.choice([0, 10, 300, 3000]))
        for _ in range(rng.choice([0, 1, 2])):
            own = word_list(items[rng.randrange(40)][1])
            own = [x if rng.random() > 0.03 else "odd" for x in own]
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("items", F.lit(2))
    found = contamination.find_items(df, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, x.item, x.shared, x.size) for r in found.collect() for x in r["items"])
    want = []
    for i, t in docs:
        s = shingle_set(t)
        for k, own in ((k, shingle_set(u)) for k, u in items):
            if own and 5 * len(own & s) >= 4 * len(own):
                want.append((i, k, len(own & s), len(own)))
    assert got == sorted(want) and found.count() == len(docs)
    # In several parts; on empty tables; with the text kept.
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(contamination, "MOST_ITEMS", 15)
    parts = contamination.find_items(df, table, other_cols=("text",))
    assert parts.columns == ["doc_id", "text", "items", "n_items"]
    assert sorted((r.doc_id, x.item, x.shared, x.size) for r in parts.collect() for x in r["items"]) == got
    assert {r.n_items for r in contamination.find_items(df, table.limit(0)).collect()} == {0}
    assert contamination.find_items(df.limit(0), table).count() == 0


# 8


def test_lm_base_counts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "The", "of", "cat", "dog", f"r{i}"], k=rng.randrange(0, 40)) + ["in", "the", "middle"] * (i % 4))) for i in range(200)] + [(500, None), (501, ""), (None, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("x"))
    train = F.col("doc_id") % 10 != 0
    got = {r.doc_id: r for r in lm.score(docs, F.coalesce(train, F.lit(False))).collect()}
    c = Counter(w for i, t in rows if i is not None and i % 10 for w in [*word_list(t), "<end>"])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        own = [*word_list(t), "<end>"]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert -1e6 < r.score <= 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_lm_bigrams_seen_once(spark):
    rows = [(i, f"a{i} b{i}") for i in range(300)] + [(1000 + i, f"a{i} b{i}") for i in range(300)] + [(2000 + i, f"a{i} b{(i + 1) % 300}") for i in range(300)]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert sum(got[1000 + i] - got[2000 + i] > 2 for i in range(300)) > 285


def brute_model(rows, train):
    """Scores by a dictionary of quantised counts."""
    q = lambda c: float(lm.value(lm.levels(np.array([c])))[0]) if c else 0.0
    one, two = Counter(), Counter()
    for i, t in rows:
        if train(i):
            w = [*word_list(t), "<end>"]
            one.update(w)
            two.update(zip(["<begin>", *w], w))
    z, ends = sum(one.values()) + 0.1 * (len(one) + 1), one["<end>"]
    out = []
    for _, t in rows:
        w = [*word_list(t), "<end>"]
        context = lambda u: max(ends, 1) if u == "<begin>" else max(q(one[u]), 1.0)
        out.append(sum(math.log10(lm.WEIGHT * min(1.0, q(two[u, v]) / context(u)) + (1 - lm.WEIGHT) * (q(one[v]) + 0.1) / z) for u, v in zip(["<begin>", *w], w)))
    return out


def test_lm_against_exact_model(spark, monkeypatch):
    """One pass or several, words sent around or joined: scores are those of a dictionary but for the filter's false hits,
    of which one in eight raises a count by a level."""
    rng = random.Random(12)
    vocab = [f"v{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 60])))) for i in range(250)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (777, None), (778, "  "), (779, "unseen words only"), (780, " ".join(rng.choices(vocab, k=30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, passes = brute_model(rows, lambda i: i % 4), []
    for limits in ({"SEGMENT": 256}, {"MOST_FILTER": 1024}, {"MOST_WORDS": 40}):
        for name, v in limits.items():
            monkeypatch.setattr(lm, name, v)
        got = {}
        for r in lm.score(docs, F.col("doc_id") % 4 != 0).collect():
            got.setdefault(r.doc_id, []).append(r)
        off = [abs(got[i][0].score - w) / max(1.0, abs(w)) for (i, _), w in zip(rows, want)]
        assert len(got[3]) == 3 and len({round(r.score, 9) for r in got[3]}) == 1
        assert np.median(off) < 0.04 and max(off) < 0.2, off
        passes.append({i: (r[0].n_tokens, r[0].n_known, round(r[0].base_score, 6), round(r[0].score, 6)) for i, r in got.items()})
    assert passes[0] == passes[1]  # the same filter in one pass and in many
    assert {i: x[:3] for i, x in passes[0].items()} == {i: x[:3] for i, x in passes[2].items()}


def test_lm_work_does_not_grow_with_the_filter(spark, monkeypatch):
    """A filter of many times what may be held at once takes as many jobs as one that fits; blocks and parts change nothing."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices([f"v{k}" for k in range(300)], k=60))) for i in range(200)] + [(900, None), (None, "v1 v2 other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, jobs = brute_model(rows, lambda i: i is not None and i % 4), []
    monkeypatch.setattr(lm, "SEGMENT", 256)
    for name, most in (("wide", 1 << 20), ("narrow", 512), ("blocks", 512)):
        monkeypatch.setattr(lm, "MOST_FILTER", most)
        if name == "blocks":
            monkeypatch.setattr(lm, "BLOCK", 100)
            monkeypatch.setattr(lm, "MOST_WORDS", 1000)
        spark.sparkContext.setJobGroup(f"lm-{name}", "")
        got = {r.doc_id: r.score for r in lm.score(docs, F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False))).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lm-{name}")))
        off = [abs(got[i] - w) / max(1.0, abs(w)) for (i, _), w in zip(rows, want, strict=True)]
        assert len(got) == len(rows) and np.median(off) < 0.04 and max(off) < 0.2, off
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1], jobs


def test_lm_filter_levels():
    rng = np.random.default_rng(2)
    h, n = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(1, 500, 5000)
    level = lm.levels(n)
    bits = int((lm.FIRST * len(h) + lm.FURTHER * level.sum()) / np.log(2)) // 8 * 8 + 64
    f = lm.Filter(1, bits, {})
    f.held[0] = np.frombuffer(f.fill(h, level), np.uint8)
    found, here = f.look_up(h)
    assert here.all() and (found >= level).all() and (found == level).mean() > 0.8
    assert (f.look_up(rng.integers(0, 2**63, 5000, dtype=np.uint64))[0] == 0).mean() > 0.98


# 9


def test_arc_and_warc_round_trip(spark, tmp_path):
    long, other = "<p>é" + "x" * 1200, "y" * 999
    rows = [(1, "http://a/ b", long), (2, None, long), (3, "u", long), (4, "u", other), (5, "u", other), (6, "u", None), (7, "u", ""), (8, "u", "line\r\n\r\nWARC/1.1\r\n" * 100), (-2, "u", "z" * 1000), (-1, "u", "z" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.write_arc(pages, arc)
    back = {r.page_id: r for r in warc.arc_records(spark, arc).collect()}
    assert {k: bytes(r.payload).decode() for k, r in back.items()} == {str(i): t or "" for i, _, t in rows}
    warc.arc_to_warc(spark, arc, out)
    got = {r.page_id: r for r in warc.read_warc(spark, out).collect()}
    for i, _, t in rows:
        data = (t or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 3), 2: ("revisit", 3), -2: ("revisit", -1)}


def test_broken_arc_is_refused():
    good = warc.arc_head(1, "f.arc", "20240101000000") + warc.arc_record(1, "http://a b", "1.2.3.4", "20240102030405", "text/html", b"body\n")
    assert list(warc.parse_arc(good)) == [("http://a b", "1.2.3.4", "20240102030405", "text/html", b"body\n")]
    assert warc.warc_date("20240102030405") == "2024-01-02T03:04:05Z"
    for bad in (good[:-4], good.replace(b"filedesc://", b"filedsc://"), good + b"no header\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


# 10


def test_tokens_as_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    rng = random.Random(10)
    signs = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "中", "\U0001f600", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "1", "--", "ing", "​", "́"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 60))) for _ in range(300)] + [None, "", " ", "a" * 3000, "word " * 4000, "▁▁"]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "n_tokens": "clash"}))
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, tokens.read_model()).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}
    assert tokens.count_tokens(docs.limit(0), tokens.read_model()).count() == 0


def test_pieces_side_by_side():
    """Whether two pieces stay apart, by undoing merges, is as merging anew has it."""
    pytest.importorskip("public_tokenizers")
    v, rng = tokens.Vocabulary(tokens.read_model()), random.Random(13)
    pieces = [p for p in v.rank if v.alone(p)]
    pairs = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(1500)]
    for p in rng.sample([p for p in pieces if len(p) > 2], 1500):
        k = rng.randrange(1, len(p))
        pairs += [(p[:k], p[k:])] if p[:k] in v.rank and p[k:] in v.rank else []
    odd = [(a, b) for a, b in pairs if v.alone(a) and v.alone(b) and v.fits(a, b) != (v.encode(a + b) == [a, b])]
    assert not odd


def test_transducer_without_breaks_and_anew(monkeypatch):
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    model, rng = tokens.read_model(), random.Random(14)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["a" * 5000, "ab" * 3000, "中文字" * 1000, "".join(rng.choices("abcdefgh", k=4000)), "x" * 300 + " y"]
    monkeypatch.setattr(tokens, "MOST_STATES", 50)
    for t in texts * 2:  # each call starts anew once there are more states
        assert tokens.compiled(model).count([t]).tolist() == [len(sp.encode(t))]


# The queries and the pipeline on the test tables


@needs_data
def test_query_columns(spark):
    from kvspark.llm.queries import queries

    want = {
        "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op3_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op4_mix": ["doc_id", "size", "source_size", "target", "taken"],
        "op8_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op10_tokens": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    }
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, columns in want.items():
        df = queries()[name](spark, DATA)
        assert set(columns) <= set(df.columns) and df.count() == n


@needs_data
def test_warc_query_as_sql(spark):
    from oracle import same_rows

    from kvspark.llm.queries import oracle_sql, queries

    same_rows(queries()["op9_warc"], oracle_sql()["op9_warc"], spark, DATA)


@needs_data
def test_pipeline_on_empty_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns
    assert p.run(spark, DATA).count() > 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and what each stage has to do with them."""
    rng = random.Random(15)
    vocab = [f"word{i}" for i in range(2000)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    bad, rows, labels = ["zarkhole", "grubface", "snotwit"], [], []
    for i in range(300):
        text = prose(60)
        if i % 3 == 0:
            text += " " + " ".join(rng.choices(bad, k=3))
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        labels.append((i, int(i % 3 == 0)))
    item, base, other = prose(40), prose(80), prose(50)
    extra = [(1000, base), (1001, base), (1002, base + " end"), (1003, prose(20) + " " + item), (1004, None), (1005, ""), (1006, other + " password=abcdefghijklmnop"), (None, prose(30)), (1007, prose(30)), (1007, prose(30)), (1008, other), (1008, other), (None, base)]
    rows += [(i, t, None if i == 1004 else "en", None if i is None else "s1", len(t or "")) for i, t in extra]
    at = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"file://{at}", rows


def test_pipeline_stages_by_plain_python(spark, planted):
    import corpus_pipeline as p

    sf, rows = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    stage = dict(p.STAGES)
    rest = lambda name, rows: sorted((tuple(r) for r in stage[name](spark, spark.createDataFrame(rows, DOCS), sf).collect()), key=key)
    toxic = lambda t: any(w in (t or "") for w in ("zarkhole", "grubface", "snotwit"))
    clean = sorted((r for r in rows if not toxic(r[1])), key=key)
    assert sorted((tuple(r) for r in stage["toxicity"](spark, docs, sf).collect()), key=key) == clean
    # near copies
    base, kept, seen = next(t for i, t, *_ in rows if i == 1000), [], set()
    for r in sorted(clean, key=key):
        copy = (base in r[1]) and r[0] != 1000 if r[1] else False
        if not copy and (not r[1] or (r[0], r[1]) not in seen):
            kept.append(r)
            seen.add((r[0], r[1]))
    other = next(t for i, t, *_ in rows if i == 1008)
    kept = [r for r in kept if not (r[0] == 1008 and r[1] == other)]  # 1006 has nearly the same words and the smaller id
    assert rest("near copies", clean) == kept
    # leaks, secrets
    left = [r for r in kept if r[0] != 1003]
    assert rest("benchmark leaks", kept) == left
    hidden = sorted(((r[0], r[1] and r[1].replace("password=abcdefghijklmnop", "[SECRET]"), *r[2:4], len(r[1].replace("password=abcdefghijklmnop", "[SECRET]")) if r[1] is not None else r[4]) for r in left), key=key)
    assert rest("secrets", left) == hidden
    mix = stage["mix"](spark, spark.createDataFrame(hidden, DOCS), sf).collect()
    per = {r.source: (r.target, sum(x.taken for x in mix if x.source == r.source)) for r in mix}
    assert all(r.taken > 0 for r in mix) and all(abs(t - k) <= 1 for t, k in per.values())
    assert Counter(map(tuple, p.run(spark, sf).collect())) == Counter(map(tuple, mix))


def test_pipeline_stages_read_extra_columns_and_repeats(spark, planted):
    import corpus_pipeline as p

    sf, _ = planted
    rows = [(1, "a b c d e f", "en", "s", 11)] * 3 + [(2, None, None, None, None)] * 2 + [(None, "", "en", "s", 0)] * 2
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "items": F.lit("x"), "key": F.lit(2), "times": F.lit(3), "spans": F.lit(4), "score": F.lit(5)})
    want = {"toxicity": 7, "near copies": 5, "benchmark leaks": 7}
    for name, n in want.items():
        found = dict(p.STAGES)[name](spark, docs, sf)
        assert found.columns == p.COLUMNS and found.count() == n
    assert dict(p.STAGES)["secrets"](spark, docs, sf).columns == p.COLUMNS
