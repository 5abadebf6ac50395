"""A corpus pipeline: toxic documents go, one of near copies stays, benchmark leaks go, secrets are put out, sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again for the next.  Part of the training-data subpackage: it goes when kvspark/llm goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kvspark.llm import contamination, jaccard, mixing, secrets, toxicity
from kvspark.llm.common import WORD, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 1/2 by a model of the labelled ones among docs; null texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(COLUMNS), model, score_col="toxicity").filter("toxicity < 0.5").select(COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least doc_id, one without an id only if none has one.

    Rows are told apart by doc_id and text, so rows of one id with different texts are documents of their own; of rows
    that are the same in both, one stays.  Documents without words stay, each of them.
    """
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"))
    rows, words = docs.select(COLUMNS).withColumn("row", row), F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    found = jaccard.jaccard_join(rows.select("row", "text"), id_col="row").filter("n_shingles > 0 AND row = component_id")
    found = materialize(found.groupBy("row").agg(F.count("*").alias("times")))
    joined = rows.filter(words).join(found, "row")
    stays = joined.filter("times = 1").select(COLUMNS)
    if not found.filter("times > 1").isEmpty():
        stays = stays.unionByName(joined.filter("times > 1").dropDuplicates(["row"]).select(COLUMNS))
    return stays.unionByName(rows.filter(~words).select(COLUMNS))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 4/5 or more."""
    found = contamination.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), other_cols=("text", "lang", "source", "n_chars"))
    return found.filter("n_items = 0").select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars as the text then is."""
    return secrets.redact(docs.select(COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: doc_id, source, size, source_size, target, copies, taken of each document that it takes words of."""
    return mixing.pareto_mix(docs).filter("taken > 0")


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_copies),
    ("benchmark leaks", without_leaks),
    ("secrets", without_secrets),
    ("mix", mixed),
]
ORACLE_SQL = None  # a trained classifier and similarity joins are no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), *([docs] if k else []))
    return STAGES[-1][1](spark, docs, sf_dir)
