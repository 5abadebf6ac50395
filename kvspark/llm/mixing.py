"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kvspark.llm.common import WORD, materialize, small

#: Digits of the rank code, in base 256: a source's cut is found by three counts of at most 256 rows a source.
DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes: (source, source_size). Adds weight and target.

    Sources in code point order, null last, weigh weights in turn and share the total of all sizes; a target stops at
    cap times its source's size and what it leaves goes to the others by weight, which is the water level
    L with sum(min(cap * size, L * weight)) = total.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    t = t.withColumn("total", F.sum("source_size").over(every).cast("double"))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source in this order that its share doesn't fill gives the level.
    t = t.withColumn("place", F.row_number().over(fill))
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))).over(every)["level"])
    return t.select("source", "source_size", "weight", F.least("most", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def inclusion(sizes: DataFrame) -> DataFrame:
    """sizes: (source, size, docs, rest), rest being the words that a source still lacks. Gives (source, slope, sure, missing).

    A document's inclusion probability is min(1, slope * sqrt(size)), with the slope at which a source's expected words
    are what it lacks: sum(min(1, slope * sqrt(size)) * size) = rest.  Documents of more than sure words have
    probability 1; missing words are left for the others.  Rows are one for each source and size, so the window is no
    longer than the largest document has words.
    """
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("source").orderBy("size").rowsBetween(1, Window.unboundedFollowing)
    words = F.col("size") * F.col("docs")
    t = sizes.filter("size > 0 AND rest > 0")
    t = t.withColumn("missing", F.col("rest") - F.coalesce(F.sum(words).over(above), F.lit(0)))
    t = t.withColumn("slope", F.col("missing") / F.sum(words * F.sqrt("size")).over(up))
    # The largest size at which the others need no certain document more.
    t = t.filter((F.col("missing") >= 0) & (F.col("slope") * F.sqrt("size") <= 1 + 1e-12))
    return t.groupBy("source").agg(F.max_by(F.struct("slope", F.col("size").alias("sure"), "missing"), "size").alias("x")).select("source", "x.*")


def rank_key(hash64: Column, chance: Column) -> Column:
    """Log of the random odds over the inclusion odds: a document with probability p has a negative one with chance p."""
    u = (F.pmod(hash64, F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.log(u / (1 - u)) - F.log(chance / (1 - chance))


def pareto_mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row.

    Every document of a source is taken floor(target / source_size) whole times; the words that the target still lacks
    are a Pareto order sample with inclusion probabilities that grow with the square root of a document's size: those
    with probability 1 are taken first, then documents in the order of their random odds over their inclusion odds
    until the words are reached.  The last one gives only as many words as are missing, so a source's words meet its
    rounded target.  Random numbers are hashes of id and text, so reruns agree.  Null text has size 0 and is never
    taken; a null source is a source of its own; repeated rows are rows like others, with one random number; an
    empty table gives an empty table.  Other columns of docs are not read.  Targets are found in one task, with a
    row for each source, so sources have to be few (millions at most), documents needn't.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    rows = materialize(rows)
    sizes = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("docs")))
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    t = targets(per, weights, cap)
    base = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    t = t.withColumn("base", base).withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("base") * F.col("source_size")))
    t = materialize(t.withColumnRenamed("source", "s"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    odds = inclusion(sizes.join(small(t.select("s", "rest")), same("source", "s")).drop("s"))
    t = materialize(t.join(odds.withColumnRenamed("source", "o"), same("s", "o"), "left").drop("o"), t, sizes)
    keyed = rows.join(small(t.drop("weight")), same("source", "s"), "left").drop("s")
    chance = F.least(F.col("slope") * F.sqrt("size"), F.lit(1 - 1e-9))
    # Rank codes: -1 is certain, null is never taken.
    top = 256**DIGITS
    code = F.least(F.lit(top - 1), F.floor(F.lit(top) / (1 + F.exp(-rank_key(F.col("h"), chance))))).cast("long")
    keyed = keyed.withColumn("key", rank_key(F.col("h"), chance))
    keyed = keyed.withColumn("code", F.when(F.col("size") > F.col("sure"), F.lit(-1).cast("long")).when(F.col("size") > 0, code))
    # The code at which a source's missing words are reached, a digit at a time.
    cut = t.filter("rest > 0").select("s", F.lit(0).cast("long").alias("cut"), F.col("missing").alias("left"))
    for digit in range(DIGITS - 1, -1, -1):
        unit = 256**digit
        near = keyed.filter("code >= 0").select("source", "size", F.floor(F.col("code") / unit).alias("d")).join(small(materialize(cut)), same("source", "s"))
        near = near.filter(F.floor(F.col("d") / 256) == F.col("cut")).groupBy("s", "cut", "left", "d").agg(F.sum("size").alias("words"))
        by = Window.partitionBy("s").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        near = near.withColumn("sum", F.sum("words").over(by)).filter(F.col("sum") > F.col("left"))
        cut = near.groupBy("s", "left").agg(F.min_by(F.struct("d", (F.col("left") - F.col("sum") + F.col("words")).alias("l")), "d").alias("x")).select("s", F.col("x.d").alias("cut"), F.col("x.l").alias("left"))
    cut = small(materialize(cut.withColumnsRenamed({"s": "c", "left": "at_cut"})))
    keyed = keyed.join(cut, same("source", "c"), "left")
    # A source without a cut lacks all its words or has none.
    before = (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("code") < F.col("cut")))
    line = Window.partitionBy("source").orderBy("key", "id", "size", "edge").rowsBetween(Window.unboundedPreceding, -1)
    edge = keyed.filter(F.col("code") == F.col("cut")).withColumn("edge", F.monotonically_increasing_id())
    edge = edge.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("at_cut") - F.coalesce(F.sum("size").over(line), F.lit(0)))))
    rest = keyed.filter(F.col("cut").isNull() | F.col("code").isNull() | (F.col("code") != F.col("cut"))).withColumn("more", F.when(before, F.col("size")).otherwise(0).cast("long"))
    cols = ["id", "source", "size", "source_size", "target", F.col("base").alias("copies"), (F.col("base") * F.col("size") + F.col("more")).cast("long").alias("taken")]
    return rest.select(cols).unionByName(edge.select(cols)).withColumnRenamed("id", id_col)


def op4_mix(spark, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    return pareto_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
