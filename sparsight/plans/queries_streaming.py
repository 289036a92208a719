"""Registered queries that run a stream over the whole table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsight.functions import text as tx
from sparsight.operators.filters import quality_strict
from sparsight.plans import flows
from sparsight.plans.catalogue import GOOD, LENGTHS, WORDS, query, r
from sparsight.session import scratch_path
from sparsight.sources.corpus import CORPUS_SCHEMA
from sparsight.streaming import ingest

BLOCK = 128


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.stream_table(spark, folder, "documents.parquet", CORPUS_SCHEMA)


def _run(
    stream: DataFrame, spark: SparkSession, mode: str = "append", checkpoint: str | None = None
) -> DataFrame:
    """Run to the end of the input into files, and read those."""
    path = scratch_path(spark, "stream")
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
    )
    if mode == "append":
        running = writer.format("parquet").option("path", path).start()
    else:
        running = writer.foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(path)
        ).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"""WITH {WORDS}
SELECT doc_id, source, unnest(range(1, len(w) + 1)) AS tok_pos, unnest(w) AS token FROM words""")
def streamed_words(spark: SparkSession, folder: str) -> DataFrame:
    return _run(ingest.stream_words(_documents(spark, folder)), spark)


@query(f"""SELECT count(*) AS tokens,
  {r('sum(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))', 'sum_sq')},
  {r('sqrt(avg(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))', 'rms')}
FROM embeddings""")
def streamed_rms(spark: SparkSession, folder: str) -> DataFrame:
    given = ingest.stream_table(spark, folder, "embeddings.parquet", "vec_id long, embedding array<float>, label int")
    return _run(ingest.running_rms(given.withColumnRenamed("embedding", "activation")), spark, "complete")


@query(f"""WITH {LENGTHS},
buckets AS (SELECT source || '-' || substr(md5(doc_id::VARCHAR), 1, 1) AS bucket, sum(n)::BIGINT AS n,
            sum(n * (n - 1) // 2)::BIGINT AS positions, sum(doc_id * n)::BIGINT AS documents FROM lengths GROUP BY 1)
SELECT bucket, (n + 127) // 128 AS n_blocks, n AS n_tokens, positions, documents FROM buckets""")
def streamed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks per (source, hash of the document), so that a source that holds
    much of the corpus is packed by many tasks. Word hashes stand in for ids.
    The short last blocks are taken from the state once the input has ended.
    """
    part = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    docs = quality_strict(_documents(spark, folder))
    ids = F.transform(tx.words(F.col("text")), lambda w: F.pmod(F.hash(w), F.lit(1 << 30)) + 2)
    seqs = docs.select(
        F.concat_ws("-", "source", part).alias("bucket"),
        "doc_id",
        F.concat(F.array(F.lit(0)), ids, F.array(F.lit(1))).alias("seq"),
    )
    # the state store provider is a property of the query, fixed as it starts
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ingest.ROCKSDB)
    checkpoint = scratch_path(spark, "stream-state")
    try:
        blocks = _run(ingest.stream_pack(seqs, BLOCK), spark, checkpoint=checkpoint)
    finally:
        spark.conf.set(name, before)
    total = lambda name: F.sum(F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x))
    return blocks.unionByName(ingest.left_over(spark, checkpoint)).groupBy("bucket").agg(
        F.count("*").alias("n_blocks"), F.sum(F.size("ids")).alias("n_tokens"),
        total("positions").alias("positions"), total("docs").alias("documents"),
    )


@query(f"""WITH {GOOD}
SELECT lang, count(*) AS n_docs, count(DISTINCT doc_id) AS n_keys FROM good GROUP BY lang""")
def streamed_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Flushed twice from one checkpoint: the second run finds nothing to do."""
    path, state = scratch_path(spark, "flushed"), scratch_path(spark, "flushed-state")
    for _ in range(2):
        docs = quality_strict(_documents(spark, folder)).select("doc_id", "lang")
        ingest.flush_shards(docs, path, state).awaitTermination()
    return spark.read.parquet(path).groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.count_distinct("doc_id").alias("n_keys")
    )
