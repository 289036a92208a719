"""The stages of the corpus pipeline: each takes and returns documents, the last packs them.

Columns that a stage does not know pass through it. Rows are told apart by id
and text; of rows that repeat both, near-dedup keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsight.llm import packing, phrase_index, secret_scan, simhash_dedup, toxicity


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; empty ones stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.trained(docs, labels)
    return toxicity.scored(docs, net, name="__score").where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = phrase_index.contamination(keyed, benchmark, doc_id="__key")
    hit = found.where(F.size("starts") > 0).select(F.col("doc_id").alias("__key"))
    return keyed.join(hit, "__key", "left_anti").drop("__key")


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and ``n_chars`` counted anew where that changed them."""
    found = secret_scan.secret_spans(docs, name="__spans")
    changed = F.size("__spans") > 0
    text = F.when(changed, secret_scan.masked(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        size = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the documents in training sequences, one row per piece."""
    return packing.digests(packing.packed(docs, public_tokenizers.path(packing.TOKENIZER)))
