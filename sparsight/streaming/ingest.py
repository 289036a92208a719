"""Streaming forms of ingest, packing, shard flush and running statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sparsight.functions import text as tx
from sparsight.operators.filters import quality_strict
from sparsight.sources.corpus import CORPUS_SCHEMA

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(
    spark: SparkSession, folder: str, table: str, schema: StructType | str, files_per_batch: int = 1_000
) -> DataFrame:
    """A stream over ``table`` in ``folder``, be it one file or a folder of files.

    The last letter stands in brackets: a source takes a plain path for a
    folder, while what a pattern finds may be either.
    """
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{table[:-1]}[{table[-1]}]")
    )


def stream_corpus(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int = 1_000
) -> DataFrame:
    """Files of documents as they arrive in ``folder``."""
    return (
        spark.readStream.schema(CORPUS_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def stream_words(documents: DataFrame) -> DataFrame:
    """Filter and flatten: one row per word, BOS being position 0. No state."""
    return quality_strict(documents).select(
        "doc_id", "source", F.posexplode(tx.words(F.col("text"))).alias("tok_pos", "token")
    ).withColumn("tok_pos", F.col("tok_pos") + 1)


def running_rms(acts: DataFrame) -> DataFrame:
    """(tokens, sum_sq, rms) over everything seen so far."""
    x = F.col("x").cast("double")
    cells = acts.select(F.posexplode("activation").alias("dim", "x"))
    return cells.agg(
        F.count_if(F.col("dim") == 0).alias("tokens"), F.sum(x * x).alias("sum_sq")
    ).withColumn("rms", F.sqrt(F.col("sum_sq") / F.col("tokens")))


_LEFT_OVER = StructType(
    [
        StructField("ids", ArrayType(IntegerType())),
        StructField("docs", ArrayType(LongType())),
        StructField("positions", ArrayType(IntegerType())),
        StructField("blocks", LongType()),
    ]
)
_BLOCK = (
    "bucket string, block_no long, docs array<long>, positions array<int>, ids array<int>"
)


def _packer(block: int, idle_ms: int | None):
    class Packer(StatefulProcessor):
        """Carries fewer than ``block`` tokens per bucket between arrivals."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.left = handle.getValueState("left", _LEFT_OVER)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
            held = [np.zeros(0, kind) for kind in (np.int32, np.int64, np.int32)]
            number = 0
            if self.left.exists():
                *arrays, number = self.left.get()
                held = [np.asarray(a, h.dtype) for a, h in zip(arrays, held)]
            for batch in rows:  # at most one Arrow batch is held at a time
                seqs = [np.asarray(s, np.int32) for s in batch["seq"]]
                sizes = [len(s) for s in seqs]
                docs = np.repeat(batch["doc_id"].to_numpy(np.int64), sizes)
                positions = [np.arange(n, dtype=np.int32) for n in sizes]
                held = [
                    np.concatenate(parts)
                    for parts in ([held[0], *seqs], [held[1], docs], [held[2], *positions])
                ]
                full = len(held[0]) // block
                if full:
                    ids, docs, positions = (
                        list(h[: full * block].reshape(full, block)) for h in held
                    )
                    yield pd.DataFrame(
                        {
                            "bucket": key[0],
                            "block_no": np.arange(number, number + full),
                            "docs": docs, "positions": positions, "ids": ids,
                        }
                    )
                    number += full
                    held = [h[full * block :] for h in held]
            self.left.update((*(h.tolist() for h in held), number))
            if idle_ms is not None:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                if len(held[0]):
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            *held, number = self.left.get() if self.left.exists() else ([], [], [], 0)
            if len(held[0]):
                ids, docs, positions = ([list(h)] for h in held)
                yield pd.DataFrame(
                    {"bucket": key[0], "block_no": [number], "docs": docs, "positions": positions, "ids": ids}
                )
                self.left.update(([], [], [], number + 1))

        def close(self) -> None:
            pass

    return Packer()


def stream_pack(seqs: DataFrame, block: int, bucket: str = "bucket", idle_ms: int | None = None) -> DataFrame:
    """Blocks of ``block`` tokens; what is left waits for the next arrival.

    With ``idle_ms`` a bucket to which nothing has come for so long gives what
    it holds as a short block, and goes on with the next number; every arrival
    sets the time anew. Times are those of the batches, so the stream needs a
    trigger that goes on without input.

    Order is per bucket: make buckets of (source, hash of the document) so
    that a large source is packed by many tasks. Needs the RocksDB state store.
    At the end of the input ``left_over`` has the tokens that still wait.
    """
    return (
        seqs.select(F.col(bucket).cast("string").alias("bucket"), "doc_id", "seq")
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=_packer(block, idle_ms), outputStructType=_BLOCK,
            outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime",
        )
    )


def left_over(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last, short block of each bucket, from the state of a stopped ``stream_pack``.

    A bucket without waiting tokens has none. The stream must have finished a batch.
    """
    state = spark.read.format("statestore").option("stateVarName", "left").load(checkpoint)
    return state.where(F.size("value.ids") > 0).select(
        "key.bucket", F.col("value.blocks").alias("block_no"), "value.docs", "value.positions", "value.ids"
    )


def flush_shards(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write every micro-batch as its own split, named after the batch number.

    A batch that is repeated after a failure overwrites its own folder, so
    nothing is written twice; with the same checkpoint a restart goes on after
    the last finished batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/split=train_{number:05d}")

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
