import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparsight.operators.joins import lookup_join
from sparsight.sources import corpus, shards


def vectors(spark, n=50, width=4):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=width).astype(np.float32)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, activation array<float>")


def test_jsonl_sets_bad_lines_aside(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"doc_id": 1, "text": "ok é"}\n{"doc_id": 2}\nnot json\n', encoding="utf-8")
    good, bad = corpus.read_jsonl(spark, str(path))
    assert [(r.doc_id, r.text) for r in good.collect()] == [(1, "ok é")]
    assert sorted(r.reason for r in bad.collect()) == ["no text", "not json"]
    assert bad.where("reason = 'not json'").first().line == "not json"


def test_percent_and_first(spark):
    df = spark.range(0, 1000, 5).withColumnRenamed("id", "doc_id")
    assert sorted(r.doc_id for r in corpus.head_percent(df, "doc_id", 2).collect()) == [0, 5, 10, 15]
    assert [r.doc_id for r in corpus.take_docs(df, "doc_id", 3).collect()] == [0, 5, 10]


def test_half_float_files_round_trip(spark, tmp_path):
    df = vectors(spark)
    files = shards.write_vectors_f16(df.coalesce(2), str(tmp_path / "f16"), target=8 * 10)
    assert files >= 5
    stored = pq.read_table(str(tmp_path / "f16"))
    assert stored.schema.field("activation").type == pa.list_(pa.float16(), 4)
    back = corpus.read_vectors_f16(spark, str(tmp_path / "f16"), "activation", "vec_id long")
    got = {r.vec_id: r.activation for r in back.collect()}
    for r in df.collect():
        assert got[r.vec_id] == [float(np.float16(v)) for v in r.activation]


def test_reads_fixed_size_half_float_lists_of_other_writers(spark, tmp_path):
    x = np.arange(12, dtype=np.float16) / 8
    column = pa.FixedSizeListArray.from_arrays(pa.array(x, pa.float16()), 3)
    pq.write_table(pa.table({"activations": column}), tmp_path / "a.parquet")
    got = corpus.read_vectors_f16(spark, str(tmp_path / "a.parquet")).collect()
    assert [v for r in got for v in r.activations] == [float(v) for v in x]


def test_shards_are_full_but_the_last(spark, tmp_path):
    df = shards.assign_shards(vectors(spark, 10), "vec_id", 4)
    shards.write_shards(df, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    counts = {r.split: r["count"] for r in back.groupBy("split").count().collect()}
    assert counts == {"train_00000": 4, "train_00001": 4, "train_00002": 2}
    assert shards.next_shard(back).first().next_shard == 3
    only = corpus.read_split(spark, str(tmp_path / "s"), "train_00001")
    assert sorted(r.vec_id for r in only.collect()) == [4, 5, 6, 7]
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_next_shard_of_nothing(spark):
    empty = spark.createDataFrame([], "split string")
    assert shards.next_shard(empty).first().next_shard == 0


def test_repack_bounds_the_files(spark, tmp_path):
    shards.repack(vectors(spark, 100).coalesce(1), str(tmp_path / "r"), 4, target=8 * 30)
    sizes = sorted(pq.read_metadata(p).num_rows for p in (tmp_path / "r").glob("*.parquet"))
    assert sizes == [10, 30, 30, 30]
    assert shards.rows_per_file(2048) == 131_072
    shards.repack(vectors(spark, 100).repartition(20), str(tmp_path / "m"), 4, target=8 * 1000)
    assert len(list((tmp_path / "m").glob("*.parquet"))) == 1  # small inputs are merged


def test_fallback_and_manifest(spark, tmp_path):
    place, error = shards.write_with_fallback(
        vectors(spark, 3), "missing-store://x", str(tmp_path / "f"), "train_00007"
    )
    assert place == str(tmp_path / "f") and error
    ok, none = shards.write_with_fallback(
        vectors(spark, 3), str(tmp_path / "t"), str(tmp_path / "f"), "train_00008"
    )
    assert ok == str(tmp_path / "t") and none is None
    table = shards.manifest(spark, [("train_00007", place, error), ("train_00008", ok, none)])
    assert table.where("error IS NULL").count() == 1


def test_pending_and_verify(spark):
    df = vectors(spark, 5).withColumn("doc_id", F.col("vec_id"))
    done = spark.createDataFrame([(1,), (3,)], "doc_id long")
    assert sorted(r.doc_id for r in shards.pending(df, done).collect()) == [0, 2, 4]
    bad = spark.createDataFrame(
        [("a", 1, [1.0, 2.0]), ("a", None, [1.0]), ("a", 1, [float("nan"), 0.0]), ("b", 2, [float("inf"), 1.0])],
        "split string, doc_id long, activation array<float>",
    )
    got = {r.split: r for r in shards.verify_shards(bad, 2).collect()}
    assert (got["a"].n_rows, got["a"].wrong_len, got["a"].no_key, got["a"].not_finite, got["a"].n_keys) == (3, 1, 1, 1, 1)
    assert got["b"].not_finite == 1


def test_stats_and_batches(spark, tmp_path):
    stats = spark.createDataFrame([(3, 1.5)], "tokens long, rms double")
    shards.write_stats(stats, str(tmp_path / "stats"))
    (file,) = (tmp_path / "stats").glob("part-*.json")
    assert json.loads(file.read_text()) == {"tokens": 3, "rms": 1.5}
    batched = vectors(spark, 20).withColumn("batch_id", F.expr("vec_id div 3"))
    shards.write_batches(batched, str(tmp_path / "b"), 2)
    assert spark.read.parquet(str(tmp_path / "b")).where("lote = 3").count() == 2


def test_lookup_join_splits_a_hot_key(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(300)]
    left = spark.createDataFrame(rows, "i long, k long")
    right = spark.createDataFrame([(k, k * 10) for k in range(300)], "k long, v long")
    small = lookup_join(left, right, ["k"], row_bytes=16)
    salted = lookup_join(left, right, ["k"], row_bytes=16, max_bytes=160, salts=8)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, salted.collect()))
    assert salted.count() == 300


def test_clustered_rows_are_written_as_they_come(spark, tmp_path):
    path = str(tmp_path / "s")
    df = shards.assign_shards(vectors(spark, 1000), "vec_id", 100).withColumn("n", F.col("vec_id").cast("int"))
    shards.write_shards(df, path, clustered=True, steps=("vec_id", "n"))
    shards.write_shards(df, path, clustered=True)  # appends
    back = spark.read.parquet(path)
    twice = {tuple(map(str, r)): r["count"] for r in back.groupBy("vec_id", "n", "split", "activation").count().collect()}
    wanted = {tuple(map(str, (r.vec_id, r.n, r.split, r.activation, 2))) for r in df.collect()}
    assert set(twice) == wanted
    assert {f.name for f in (tmp_path / "s").iterdir()} == {f"split=train_{i:05d}" for i in range(10)}
    for file in (tmp_path / "s").glob("*/*.parquet"):
        ids = pq.read_table(file, partitioning=None)["vec_id"].to_pylist()
        assert ids == list(range(ids[0], ids[-1] + 1))


def test_unordered_splits_and_failing_writes(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(40).select("id", F.format_string("s%d", F.col("id") % 3).alias("split")).coalesce(1)
    shards.write_shards(df, path, clustered=True)
    back = spark.read.parquet(path)
    assert sorted((r.id, r.split) for r in back.collect()) == [(i, f"s{i % 3}") for i in range(40)]
    late = df.withColumn("id", F.when(F.col("id") == 39, F.raise_error(F.lit("late"))).otherwise(F.col("id")))
    for bad in (late, df.withColumn("split", F.lit("a/b")), df.withColumn("split", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="late|name of a split"):
            shards.write_shards(bad, path, clustered=True)
    assert spark.read.parquet(path).count() == 40
    assert {f.name for f in (tmp_path / "s").iterdir() if f.name[0] not in "._"} == {"split=s0", "split=s1", "split=s2"}
