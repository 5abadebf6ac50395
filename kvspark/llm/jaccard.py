"""Exact set-similarity join on word shingles by PartEnum signatures.

Two sets of at most r elements with Jaccard similarity 4/5 differ in at most k = 2r/9 elements.  The domain is split by
hash in n1 parts and each of these in three.  At most k/2 of the n1 parts hold two differing elements or more; in every
other one, at least two of the three smaller parts agree.  A set signs, for each of the n1 parts, the three subsets of
two of its smaller parts, so sets that link share at least n1 - k/2 signatures.  Small sets (k <= 3) have one part, split
in k + 3, and sign every subset of three.  Sizes go in bands [l, 5l/4]; a set signs for its own band and the next, which
is where sets that can link with it lie.

Before that, sets are put aside that can't link by an exact filter.  A set of n elements has at most n/5 outside of any
set that it links with; if more of its elements than that are in no other set, nothing links with it.  A fixed share of
the domain is enough to look at, as what is seen there of elements of its own is a lower bound.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kvspark.llm.common import components, drop, long_array, materialize, mix, shingles, slices, small, text_bytes, word_hashes

_U = np.uint64
WIDTH = 5
#: Members of one block when a bucket's pairs are compared block by block.
BLOCK = 256
#: Elements whose hash lies below this are counted over all sets: one of four.
LOOKED_AT = _U(1 << 62)
#: Rows of one call that compares the blocks of buckets by their bits.
CALL_ROWS = 4000


def _bounds() -> np.ndarray:
    """Lower ends of the size bands."""
    at = [1]
    while at[-1] < 1 << 40:
        at.append(at[-1] * 5 // 4 + 1)
    return np.array(at)


BANDS = _bounds()


def text_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat shingles of the rows of a text column, sorted within a row, and the number of each row."""
    buf, offsets = text_bytes(column)
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in slices(offsets):
        words, row = word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        h, doc = shingles(words, row, b - a, WIDTH)
        parts.append(h)
        counts.append(np.bincount(doc, minlength=b - a))
    return np.concatenate(parts), np.concatenate(counts)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of runs of values."""
    total = np.concatenate([[_U(0)], np.cumsum(values, dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return total[at[1:]] - total[at[:-1]]


def set_keys(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set: equal sets have equal keys."""
    return mix(_sums(mix(h), counts) + counts.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def _sign_few(h: np.ndarray, counts: np.ndarray, tag: np.ndarray, k: int):
    """Signatures of sets that differ in k <= 3 elements at most: each subset of three of k + 3 parts (one part for 0)."""
    n, doc = (k + 3 if k else 1), np.repeat(np.arange(len(counts)), counts)
    seed = mix(tag.astype(np.uint64) + _U(77))
    part = doc * n + (mix(h + seed[doc]) % _U(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    size = np.bincount(part, minlength=n * len(counts))
    sums = mix(_sums(mix(h[order] ^ _U(0x5851F42D4C957F2D)), size) + size.astype(np.uint64)).reshape(-1, n)
    zero = np.zeros(len(counts), np.int64)
    for c, chosen in enumerate(combinations(range(n), min(n, 3))):
        sig = np.zeros(len(counts), np.uint64)
        for p in chosen:
            sig = mix(sig + sums[:, p] + _U(p))
        yield np.arange(len(counts)), mix(sig + mix(seed + _U(1 << 40 | c))), zero


def _sign_many(h: np.ndarray, counts: np.ndarray, tag: np.ndarray, k: np.ndarray):
    """Signatures of larger sets: of each first part, the three pairs of its three smaller parts."""
    n, doc = k // 2 + k // 10 + 2, np.repeat(np.arange(len(counts)), counts)
    base = np.concatenate([[0], np.cumsum(n)])
    seed = mix(tag.astype(np.uint64) + _U(77))
    at = mix(h + seed[doc])
    part = 3 * (base[doc] + (at % n[doc].astype(np.uint64)).astype(np.int64)) + (mix(at) % _U(3)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    size = np.bincount(part, minlength=3 * base[-1])
    sums = mix(_sums(mix(h[order] ^ _U(0x5851F42D4C957F2D)), size) + size.astype(np.uint64)).reshape(-1, 3)
    size = size.reshape(-1, 3)
    of = np.repeat(np.arange(len(counts)), n)
    number = (np.arange(base[-1]) - base[of]).astype(np.uint64)
    # Subsets that are empty in both sets say nothing, unless a set has so many that they could be all that agree.
    agree = n - k // 2
    hollow = np.bincount(of[(size == 0).sum(1) >= 2], minlength=len(counts))
    spare = np.where(hollow >= agree, 0, agree - hollow - 1)
    for c, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        w = size[:, x] + size[:, y]
        sig = mix(mix(sums[:, x] + _U(c + 1)) + sums[:, y] + mix(seed[of] + number * _U(4) + _U(c)))
        say = np.flatnonzero((w > 0) | (hollow >= agree)[of])
        yield of[say], sig[say], spare[of[say]]


def signatures(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(set, signature, tag, spare): tag is the band that is signed for; sets that link share more than spare signatures for it."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)]
    band = np.searchsorted(BANDS, counts, "right") - 1
    doc = np.repeat(np.arange(len(counts)), counts)
    for ahead in (0, 1):
        tag = band + ahead
        k = 2 * (BANDS[tag + 1] - 1) // 9
        for few in range(5):  # the last: all larger ones
            sets = np.flatnonzero((counts > 0) & ((k == few) if few < 4 else (k > 3)))
            if not sets.size:
                continue
            chosen = np.zeros(len(counts), bool)
            chosen[sets] = True
            args = h[chosen[doc]], counts[sets], tag[sets]
            for of, sig, spare in _sign_few(*args, few) if few < 4 else _sign_many(*args, k[sets]):
                out.append((sets[of], sig, tag[sets[of]], spare))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _narrow(batches):
    for batch in batches:
        h, counts = text_sets(batch.column(1))
        seen = h < LOOKED_AT
        n = np.diff(np.concatenate([[0], np.cumsum(seen)])[np.concatenate([[0], np.cumsum(counts)])])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(set_keys(h, counts).view(np.int64)), long_array(h[seen], n)], ["id", "n", "key", "seen"])


def _sets(batches):
    for batch in batches:
        h, counts = text_sets(batch.column(1))
        keys = set_keys(h, counts).view(np.int64)
        same = np.flatnonzero((keys == batch.column(2).to_numpy(zero_copy_only=False)) & (counts > 0))
        if len(same):
            arrays = long_array(h, counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys[same]), pa.array(counts[same]), arrays.take(pa.array(same))], ["key", "n", "items"])


def _postings(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            items = part.column(1)
            counts = np.diff(items.offsets.to_numpy())
            doc, sig, *numbers = signatures(items.flatten().to_numpy(zero_copy_only=False).view(np.uint64), counts)
            keys = part.column(0).to_numpy(zero_copy_only=False)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(keys), *(pa.array(x.astype(np.int32)) for x in numbers)], ["sig", "key", "tag", "spare"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that link."""
    left, right = (sets.select(F.col("key").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
    m, n = F.size("a_items"), F.size("b_items")
    both = pairs.join(left, "a").join(right, "b").filter(5 * F.least(m, n) >= 4 * F.greatest(m, n))
    return materialize(both.filter(9 * F.size(F.array_intersect("a_items", "b_items")) >= 4 * (m + n)).select("a", "b"))


def _bits(batches):
    """Of each set and each of its two bands, a bit for each element, at 8 bits for each element that the band allows."""
    for batch in batches:
        items = batch.column(1)
        at, h = items.offsets.to_numpy(), items.values.to_numpy(zero_copy_only=False).view(np.uint64)
        band = np.searchsorted(BANDS, np.diff(at), "right") - 1
        out = []
        for k, key in enumerate(batch.column(0).to_pylist()):
            own = mix(h[at[k] : at[k + 1]] ^ _U(0x2545F4914F6CDD1D))
            for tag in (int(band[k]), int(band[k]) + 1):
                flags = np.zeros(8 * (int(BANDS[tag + 1]) - 1), np.uint8)
                flags[(own % _U(len(flags))).astype(np.int64)] = 1
                out.append((key, tag, len(own), np.packbits(flags).tobytes()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["key", "tag", "n", "bits"])


def _compare(table, every: bool):
    """Pairs of members of different components that can link by their bits: each bit in which two sets differ stands for
    an element in which they differ, at least.  kind 0: two blocks of members outside of a bucket's largest component;
    1: a block of these and one of the largest component; 2: a bucket of one block of each.  Of a member's pairs with one
    component, all or else the likeliest with the number of the others (more)."""
    sig, kind, i, j, block, comp, key, n, outer = (table.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "kind", "i", "j", "block", "component", "key", "n", "outer"))
    bits = table.column("bits").combine_chunks()
    order = np.lexsort((j, i, kind, sig))
    change = np.zeros(len(order), bool)
    for c in (sig, kind, i, j):
        change[1:] |= np.diff(c[order]) != 0
    found = [np.zeros((0, 3), np.int64)]
    for of in np.split(order, np.flatnonzero(change)):
        if kind[of[0]] == 0:
            left, right = of[block[of] == i[of[0]]], of[block[of] == j[of[0]]]
        else:
            left, right = of[outer[of]], of[~outer[of]] if kind[of[0]] == 1 else of
        if not len(left) or not len(right):
            continue
        flags = np.frombuffer(b"".join(bits[int(x)].as_py() for x in right), np.uint8).reshape(len(right), -1)
        for a in left:
            both = n[a] + n[right]
            most = both - 2 * ((4 * both + 8) // 9)  # elements in which two sets that link can differ
            apart = np.bitwise_count(flags ^ np.frombuffer(bits[int(a)].as_py(), np.uint8)).sum(1, dtype=np.int64)
            ok = np.flatnonzero((apart <= most) & (comp[right] != comp[a]))
            hit, more = right[ok], np.zeros(len(ok), np.int64)
            if not every and len(ok):
                likely = np.lexsort((key[hit], apart[ok], comp[hit]))
                _, first, times = np.unique(comp[hit][likely], return_index=True, return_counts=True)
                hit, more = hit[likely[first]], times - 1
            found.append(np.stack([np.minimum(key[a], key[hit]), np.maximum(key[a], key[hit]), more], 1))
    found = np.concatenate(found)
    found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return pa.table(dict(zip(("a", "b", "more"), found[new].T, strict=True)))


def _mixed(member: DataFrame, reached: DataFrame, r: int) -> DataFrame:
    """Of members (sig, key, ...) those of buckets with several components, with their component and most, the largest
    component of the bucket and a member of it, and all, the number of the bucket's members."""
    known = member.join(small(reached.withColumnRenamed("node", "key")), "key", "left").withColumn("component", F.coalesce("component", "key"))
    parts = known.groupBy("sig", "component").agg(F.count("*").alias("k"), F.min_by("key", F.xxhash64("key", F.lit(r))).alias("lead"))
    mixed = parts.groupBy("sig").agg(F.max_by(F.struct("component", "lead", "k"), F.struct("k", "component")).alias("most"), F.sum("k").alias("all"))
    mixed = materialize(mixed.filter("all > most.k"))
    return materialize(known.join(small(mixed), "sig"), mixed)


MEMBER = ["sig", "key", "members", "tag", "spare", "times"]


def _needed(member: DataFrame) -> DataFrame:
    """Members of mixed buckets, without those places of a set that lie in its most frequent buckets, spare in all.

    Two sets of different components that link share more than spare of the set's signatures, all of them in mixed
    buckets; in an order that is the same for all, the first of these is followed by the others, so it isn't among the
    last ones of either set, which are left out.  What many documents share says no more than what few share.
    """
    by = Window.partitionBy("key", "tag").orderBy(F.desc("members"), "sig").rowsBetween(Window.unboundedPreceding, 0)
    return member.withColumn("place", F.sum("times").over(by)).filter("place > spare").select(MEMBER)


def link_classes(sets: DataFrame) -> DataFrame:
    """(key, component) of the sets (key, n, items) that link with another one; component is a key.

    Members of a bucket of two are compared; others with that one of their buckets' least members with which they share
    most.  In buckets that hold several components after that, the others are compared with a member of the largest.
    In those that still do, members outside of the largest component are compared with all members of other components,
    block by block, by bits that put aside most pairs that can't link; what is left is compared by elements, a member with
    the likeliest of each component first.  So no link between components is lost, and links within a component needn't be found.
    """
    postings = sets.select("key", "items").mapInArrow(_postings, "sig long, key long, tag int, spare int")
    met = materialize(postings.groupBy("sig").agg(F.count("*").alias("members"), F.min("key").alias("lead")).filter("members > 1"))
    shared = materialize(postings.join(small(met), "sig"), met)
    met_lead = shared.filter("key <> lead").groupBy(F.col("lead").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("times"), F.min("members").alias("members"))
    met_lead = materialize(met_lead)
    best = met_lead.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")
    checked = materialize(met_lead.filter("members = 2").select("a", "b").unionByName(best).distinct(), met_lead)
    links = _linked(checked, sets)
    # Buckets of one band with equal members are one, which counts times.
    groups = shared.filter("members > 2").groupBy("sig", "tag", "members").agg(F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("all"))
    one = materialize(groups.groupBy("tag", "members", "all").agg(F.min("sig").alias("sig"), F.count("*").alias("times")).select("sig", "times"))
    member = materialize(shared.filter("members > 2").select("sig", "key", "members", "tag", "spare").join(small(one), "sig"), shared, one)
    reached = components(links)
    mixed = _mixed(member, reached, 1)
    member = materialize(mixed.select(MEMBER), member, reached)
    # All meet a member of their buckets' largest components.
    pairs = mixed.filter(F.col("component") != F.col("most.component")).select(F.least("most.lead", "key").alias("a"), F.greatest("most.lead", "key").alias("b")).distinct()
    links, checked = _add(pairs, links, checked, sets)
    drop(mixed)
    reached = components(links)
    mixed = _mixed(member, reached, 2)
    needed = materialize(_needed(mixed), member, mixed)
    mixed = _mixed(needed, reached, 2)
    # Likely pairs of a member and a component first; the others only where the likeliest is no link.
    near = _near(mixed, sets, False)
    drop(mixed)
    links, checked = _add(near.select("a", "b"), links, checked, sets)
    drop(reached)
    reached = components(links)
    now = small(reached.withColumnRenamed("node", "key"))
    of = lambda c: near.filter("more > 0").select("a", "b", F.col(c).alias("key")).join(now, "key", "left").select("a", "b", F.coalesce("component", "key").alias(f"in_{c}"))
    still = of("a").join(of("b"), ["a", "b"]).filter("in_a <> in_b").select(F.explode(F.array("a", "b")).alias("key")).distinct()
    still = materialize(still, near)
    if not still.isEmpty():
        again = materialize(needed.join(small(still), "key", "left_semi").select("sig").distinct())
        mixed = _mixed(needed.join(small(again), "sig", "left_semi"), reached, 3)
        near = _near(mixed, sets, True)
        links, checked = _add(near.select("a", "b"), links, checked, sets)
        drop(reached, again, mixed, near)
        reached = components(links)
    drop(needed, still, links, checked)
    return reached


def _add(pairs: DataFrame, links: DataFrame, checked: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and checked pairs with those of the pairs (a, b), a the less, that haven't been compared before."""
    new = materialize(pairs.join(small(checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), ["a", "b"], "left_anti"))
    more = _linked(new, sets)
    return materialize(links.unionByName(more), links, more), materialize(checked.unionByName(new), checked, new)


def _near(mixed: DataFrame, sets: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b, more) that can link of members outside of their bucket's largest component with those of other components."""
    n = lambda k: F.ceil(k / F.lit(BLOCK)).cast("int")
    placed = mixed.withColumns({"outer": F.col("component") != F.col("most.component"), "few": n(F.col("all") - F.col("most.k")), "many": n(F.col("most.k"))})
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.when(F.col("outer"), F.col("few")).otherwise(F.col("many"))).cast("int"))
    call = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.transform(upto(F.col("few")), lambda o: call(0, F.least("block", o), F.greatest("block", o)))
    other = F.transform(upto(F.col("many")), lambda o: call(1, F.col("block"), o))
    large = F.transform(upto(F.col("few")), lambda o: call(1, o, F.col("block")))
    one = F.array(call(2, F.lit(0), F.lit(0)))
    placed = placed.withColumn("x", F.explode(F.when((F.col("few") == 1) & (F.col("many") == 1), one).when(F.col("outer"), F.concat(own, other)).otherwise(large)))
    placed = materialize(placed.select("sig", "key", "tag", "component", "outer", "block", "x.kind", "x.i", "x.j"))
    calls = max(1, placed.count() // CALL_ROWS)
    keys = materialize(placed.select("key").distinct())
    bits = materialize(sets.select("key", "items").join(small(keys), "key", "left_semi").mapInArrow(_bits, "key long, tag int, n long, bits binary"), keys)
    joined = placed.withColumn("call", F.pmod(F.xxhash64("sig", "kind", "i", "j"), F.lit(calls))).join(bits, ["key", "tag"])
    found = joined.groupBy("call").applyInArrow(lambda table: _compare(table, every), "a long, b long, more long")
    return materialize(found.groupBy("a", "b").agg(F.max("more").alias("more")), placed, bits)


def _kept_sets(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """(key, n, items) of the different sets that the filter leaves; narrow: (id, n, key, seen)."""
    kind = rows.schema["id"].dataType.simpleString()
    held = narrow.select("key", F.explode("seen").alias("h")).groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    alone = materialize(held.filter("key = last").groupBy("key").agg(F.count("*").alias("alone")))
    kept = narrow.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    kept = materialize(kept.join(small(alone), "key", "left").filter("5 * coalesce(alone, 0) <= n").select("id", F.col("key").alias("want")), alone)
    found = rows.join(small(kept.filter("id IS NOT NULL")), "id").select("id", "text", "want")
    if not (unnamed := kept.filter("id IS NULL")).isEmpty():  # rows without an id are found by their sets
        keyed = rows.filter("id IS NULL").mapInArrow(_narrow_texts, f"id {kind}, text string, want long")
        found = found.unionByName(keyed.join(unnamed.select("want"), "want", "left_semi").select("id", "text", "want"))
    sets = found.mapInArrow(_sets, "key long, n long, items array<long>")
    return materialize(sets.groupBy("key").agg(F.first("n").alias("n"), F.first("items").alias("items")), kept)


def _narrow_texts(batches):
    for batch in batches:
        keys = set_keys(*text_sets(batch.column(1)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], ["id", "text", "want"])


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): rows whose 5-word shingle sets have similarity 4/5 are linked; a component is named
    by its least id.

    Words are lower-cased in A-Z.  Fewer than five words are one shingle; null texts and texts without words have no
    shingles and stay alone.  Equal sets link.  Rows of one id with several texts tie these together.  A row without an
    id takes part like any other and gets its component's least id, null if all of it have none.  An empty table gives
    an empty table; other columns of docs are not read.  Elements and sets are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    narrow = materialize(rows.mapInArrow(_narrow, f"id {kind}, n long, key long, seen array<long>"))
    sets = _kept_sets(rows, narrow)
    narrow = materialize(narrow.select("id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")), narrow)
    reached = link_classes(sets)
    drop(sets)
    some = narrow.filter("key IS NOT NULL")
    several = materialize(some.filter("id IS NOT NULL").groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b"))
    if not several.isEmpty():
        ties = some.join(several.select("id", "a"), "id").select("a", F.col("key").alias("b"))
        reached = components(materialize(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(ties).distinct(), reached))
    drop(several)
    classes = some.groupBy("key").agg(F.min("id").alias("id")).join(small(reached.withColumnRenamed("node", "key")), "key", "left")
    classes = materialize(classes.select("key", "id", F.coalesce("component", "key").alias("component")), reached)
    named = materialize(classes.groupBy("component").agg(F.min("id").alias("component_id")))
    owners = materialize(classes.join(small(named), "component").select("key", "component_id"), classes, named)
    found = narrow.join(small(owners), "key", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
