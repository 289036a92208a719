import shutil
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparsight.functions import text
from sparsight.operators.filters import quality_strict
from sparsight.plans import queries_streaming
from sparsight.streaming import ingest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def drop(spark, folder, rows):
    rows = [(i, t, "en", s, len(t)) for i, t, s in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def arrivals(n, start=0):
    return [(start + i, f"Document number {start + i} has some words " * (1 + i % 4), f"s{i % 2}") for i in range(n)]


def run(stream, sink, state, mode="append"):
    query = (
        stream.writeStream.format("parquet").option("path", str(sink)).outputMode(mode)
        .option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_packing_carries_the_rest_between_arrivals(spark, tmp_path):
    source, sink, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    block, everything = 16, []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.ROCKSDB)
    for round_ in range(3):
        rows = arrivals(9, round_ * 9)
        everything += rows
        drop(spark, source, rows)
        docs = ingest.stream_corpus(spark, str(source))
        seqs = docs.select(
            F.col("source").alias("bucket"), "doc_id",
            F.sequence(F.lit(0), F.size(F.split("text", " "))).alias("seq"),
        )
        run(ingest.stream_pack(seqs, block), sink, state)
    blocks = spark.read.parquet(str(sink)).collect()
    tokens = defaultdict(list)
    for doc, text, bucket in everything:
        tokens[bucket] += [(doc, p, p) for p in range(len(text.split(" ")) + 1)]
    packed = defaultdict(list)
    for b in sorted(blocks, key=lambda r: (r.bucket, r.block_no)):
        assert len(b.ids) == block
        packed[b.bucket] += list(zip(b.docs, b.positions, b.ids))
    left = {r.bucket: r for r in ingest.left_over(spark, str(state)).collect()}
    for bucket, all_tokens in tokens.items():
        rest = left.get(bucket)
        waiting = list(zip(rest.docs, rest.positions, rest.ids)) if rest else []
        assert sorted(packed[bucket] + waiting) == sorted(all_tokens)
        numbers = [b.block_no for b in blocks if b.bucket == bucket]
        assert sorted(numbers) == list(range(len(all_tokens) // block))
        assert len(set(packed[bucket])) == len(packed[bucket])
        assert set(packed[bucket]) <= set(all_tokens)
        by_doc = defaultdict(list)
        for doc, p, _ in packed[bucket]:
            by_doc[doc].append(p)
        assert all(ps == list(range(len(ps))) for ps in by_doc.values())


def test_idle_buckets_give_what_they_hold_while_the_stream_runs(spark, tmp_path):
    source, sink, block = tmp_path / "in", tmp_path / "out", 16
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.ROCKSDB)
    source.mkdir()
    docs = ingest.stream_corpus(spark, str(source))
    seqs = docs.select(
        F.col("source").alias("bucket"), "doc_id", F.sequence(F.lit(0), F.size(F.split("text", " "))).alias("seq")
    )
    query = (
        ingest.stream_pack(seqs, block, idle_ms=500).writeStream.format("parquet").option("path", str(sink))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    )
    expected, n_tokens = defaultdict(list), 0
    try:
        for round_ in range(3):
            rows = arrivals(5, round_ * 5)
            for doc, text, bucket in rows:
                size = len(text.split(" ")) + 1
                expected[bucket] += [(doc, p, p) for p in range(size)]
                n_tokens += size
            drop(spark, source, rows)
            # the stream is not stopped: everything comes out by itself before the next arrival
            blocks, end = [], time.monotonic() + 90
            while sum(len(b.ids) for b in blocks) < n_tokens and time.monotonic() < end and query.exception() is None:
                time.sleep(0.5)
                if (sink / "_spark_metadata").exists():
                    blocks = spark.read.schema(ingest._BLOCK).parquet(str(sink)).collect()
            assert query.exception() is None and sum(len(b.ids) for b in blocks) == n_tokens
    finally:
        query.stop()
    for bucket, tokens in expected.items():
        mine = sorted((b for b in blocks if b.bucket == bucket), key=lambda b: b.block_no)
        assert [b.block_no for b in mine] == list(range(len(mine)))
        assert sorted(t for b in mine for t in zip(b.docs, b.positions, b.ids)) == sorted(tokens)
        # one short block for each arrival at most, none too long
        assert sum(len(b.ids) < block for b in mine) <= 3 and max(len(b.ids) for b in mine) <= block
    assert ingest.left_over(spark, str(tmp_path / "state")).count() == 0


def test_words_of_the_stream_equal_the_batch(spark, tmp_path):
    drop(spark, tmp_path / "in", arrivals(6) + [(99, "SHOUTED TEXT THAT IS LONG ENOUGH", "s0")])
    run(ingest.stream_words(ingest.stream_corpus(spark, str(tmp_path / "in"))), tmp_path / "out", tmp_path / "state")
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = quality_strict(spark.read.parquet(str(tmp_path / "in")))
    expected = sum(len(r.text.split()) for r in batch.collect())
    assert got.count() == expected and got.where("doc_id = 99").count() == 0
    assert got.agg(F.min("tok_pos")).first()[0] == 1


def test_flush_goes_on_after_a_restart(spark, tmp_path):
    source, path, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for round_ in range(2):
        drop(spark, source, arrivals(5, round_ * 5))
        for _ in range(2):  # the second start finds nothing new
            ingest.flush_shards(ingest.stream_corpus(spark, str(source)), path, state).awaitTermination()
    got = spark.read.parquet(path)
    assert sorted(r.doc_id for r in got.collect()) == list(range(10))
    assert sorted(r.split for r in got.select("split").distinct().collect()) == ["train_00000", "train_00001"]


def test_running_rms(spark, tmp_path):
    schema = "activation array<float>"
    spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        ingest.running_rms(stream).writeStream.outputMode("complete").format("memory")
        .queryName("rms").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    row = spark.table("rms").first()
    assert row.tokens == 2 and abs(row.rms - 12.5**0.5) < 1e-9


@pytest.mark.parametrize("as_folder", [False, True])
def test_queries_read_tables_of_one_file_or_of_a_folder(spark, tmp_path, as_folder):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    for name, table in (("documents", given), ("embeddings", vectors)):
        if as_folder:
            table.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        else:
            shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    folder, good = str(tmp_path), quality_strict(given)
    assert queries_streaming.streamed_rms(spark, folder).first().tokens == vectors.count()
    words = good.select(F.size(text.words(F.col("text"))).alias("n")).agg(F.count("*"), F.sum("n")).first()
    blocks = queries_streaming.streamed_blocks(spark, folder).agg(F.sum("n_tokens"), F.sum("documents")).first()
    assert blocks[0] == words[1] + 2 * words[0]
    assert queries_streaming.streamed_shards(spark, folder).agg(F.sum("n_docs"), F.sum("n_keys")).first()[:] == (words[0],) * 2
    assert queries_streaming.streamed_words(spark, folder).count() == words[1]
