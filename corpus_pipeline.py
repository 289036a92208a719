"""A corpus from documents: toxic texts out, one of each near-duplicate, benchmark text and secrets out, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparsight.llm import stages
from sparsight.session import materialize, ship_package

STAGES = [
    ("toxicity", stages.clean_language),
    ("near_dedup", stages.one_of_each),
    ("decontamination", stages.decontaminated),
    ("secrets", stages.masked),
    ("packing", stages.packed),
]

#: hashing, a trained network and packing are beyond SQL; tests hold each stage against plain code
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before left, written in between."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
