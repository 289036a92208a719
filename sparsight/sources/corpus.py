"""Readers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparsight.operators.ordering import index_documents

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
_CORRUPT = "_corrupt_record"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores where a scan has fewer splits than cores.

    Never applies to a large table; a small file would otherwise leave the
    whole text work to one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def read_corpus(spark: SparkSession, path: str, heavy: bool = True) -> DataFrame:
    """Documents with an explicit schema; filters and columns reach the scan.

    ``heavy`` says that work on the texts follows, see ``spread``.
    """
    docs = spark.read.schema(CORPUS_SCHEMA).parquet(path)
    return spread(docs, "doc_id") if heavy else docs


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, label, activation) from a table of vectors."""
    raw = spark.read.schema("vec_id long, embedding array<float>, label int").parquet(path)
    return spread(raw.withColumnRenamed("embedding", "activation"), "vec_id")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a JSON-lines corpus with one ``text`` per line.

    A line that is no JSON, or has no text, goes to ``bad`` as it stands.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField(_CORRUPT, T.StringType()),
        ]
    )
    rows = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
    )
    broken = F.col(_CORRUPT).isNotNull() | F.col("text").isNull()
    good = rows.where(~broken).drop(_CORRUPT)
    bad = rows.where(broken).select(
        "doc_id",
        F.col(_CORRUPT).alias("line"),
        F.when(F.col(_CORRUPT).isNotNull(), "not json").otherwise("no text").alias("reason"),
    )
    return good, bad


def head_percent(
    df: DataFrame, key: str, percent: float, splits: list[float] | None = None
) -> DataFrame:
    """The first round(n * percent / 100) rows in key order, halves up."""
    n = df.count()
    keep = math.floor(n * percent / 100 + 0.5)
    return index_documents(df, key, "_idx", splits).where(F.col("_idx") < keep).drop("_idx")


def take_docs(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def read_matrices(spark: SparkSession, path: str, column: str = "activacion") -> DataFrame:
    """One activation matrix (tokens x width) per document."""
    return spark.read.schema(f"doc_id long, {column} array<array<float>>").parquet(path)


def read_vectors_f16(
    spark: SparkSession, path: str, column: str = "activations", extra: str = ""
) -> DataFrame:
    """Vectors stored as half floats, which have no type of their own in Spark.

    The scan takes each element as two bytes; one Arrow batch call turns them
    into floats.
    """
    from sparsight.functions.vectors import f16_bytes_to_floats

    prefix = f"{extra}, " if extra else ""
    raw = spark.read.schema(f"{prefix}{column} array<binary>").parquet(path)
    return raw.withColumn(column, f16_bytes_to_floats(column))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One named split; only its folder is listed and read."""
    return spark.read.parquet(path).where(F.col("split") == split)
