"""Orders without a sort, the latest saved row, keys compared, files packed by size."""

import random

import pytest
from pyspark.sql import functions as F

from sparsight.operators.asof import as_of
from sparsight.operators.ordering import Permutation, buffer_shuffle, epoch_order
from sparsight.sources import shards


def test_permutations_are_bijections_with_an_inverse():
    for n in (1, 2, 3, 10, 97, 1000):
        places = [[Permutation.of(n, 42, e).place(i) for i in range(n)] for e in range(3)]
        for e, p in enumerate(places):
            assert sorted(p) == list(range(n))
            assert [Permutation.of(n, 42, e).at(x) for x in p] == list(range(n))
        assert n < 10 or len({tuple(p) for p in places}) == 3
    large = Permutation.of(10**15, 1)
    assert all(large.at(large.place(i)) == i for i in range(0, 10**15, 10**13))


@pytest.mark.parametrize("n", [1000, 10**13])
def test_places_of_a_column(spark, n):
    df = spark.range(0, n, n // 100).withColumnRenamed("id", "doc_idx")
    shuffled = epoch_order(df, n, 3)
    order = Permutation.of(n, 42, 3)
    assert all(r.epoch_idx == order.place(r.doc_idx) for r in shuffled.collect())
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_buffer_shuffle_moves_rows_within_its_bound(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(7)
    cuts = [500.0, 700.5, 2000.0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)  # the buffer is carried from batch to batch
    try:
        first = [tuple(r) for r in buffer_shuffle(df, size=50, splits=cuts).collect()]
        again = [tuple(r) for r in buffer_shuffle(df, size=50, splits=cuts).collect()]
        other = [tuple(r) for r in buffer_shuffle(df, size=50, seed=1, splits=cuts).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(first) == sorted(again) != sorted(other)
    assert sorted(r[0] for r in first) == list(range(3000))
    ranges = {}
    for doc, _, part, place in first:
        ranges.setdefault(part, []).append((doc, place))
    assert len(ranges) == 4
    for rows in ranges.values():
        own = {doc: i for i, (doc, _) in enumerate(sorted(rows))}
        assert sorted(p for _, p in rows) == list(range(len(rows)))
        assert all(own[doc] - place < 50 for doc, place in rows)
        assert sum(own[doc] != place for doc, place in rows) > len(rows) * 0.9
    assert buffer_shuffle(df.where("false")).count() == 0
    few = buffer_shuffle(df.where("doc_id < 3"), size=50).collect()
    assert sorted(r.doc_id for r in few) == [0, 1, 2]


def plain_as_of(rows, saved):
    out = []
    for key, t, name in rows:
        near = [(s, v) for k, s, v in saved if None not in (key, t, s) and k == key and s <= t]
        out.append((key, t, name, *(max(near) if near else (None, None))))
    return sorted(out, key=str)


def test_as_of_matches_plain_code(spark):
    rng = random.Random(2)
    # one key with nearly all rows, ties, repeats and nulls
    rows = [(rng.choice(["a"] * 9 + ["b", None]), rng.choice([None, *range(200)]), f"r{i % 50}") for i in range(600)]
    saved = [(rng.choice(["a"] * 9 + ["b", "c", None]), rng.choice([None, *range(0, 200, 7)]), i) for i in range(80)]
    left = spark.createDataFrame(rows, "key string, t bigint, name string").repartition(3)
    right = spark.createDataFrame(saved, "key string, at bigint, value int").repartition(3)
    for splits in (None, [], [50.0, 50.5, 120.0]):
        got = sorted((tuple(r) for r in as_of(left, right, ["key"], "t", "at", splits).collect()), key=str)
        assert got == plain_as_of(rows, saved)
    assert as_of(left.where("false"), right, ["key"], "t", "at").count() == 0
    none = as_of(left, right.where("false"), ["key"], "t", "at").collect()
    assert len(none) == 600 and all(r["at"] is None for r in none)


def test_keys_are_compared_with_their_repeats(spark):
    listed = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "doc_id int")
    stored = spark.createDataFrame([(1,), (3,), (None,)], "doc_id int")
    got = sorted((str(r.doc_id), r.status, r.n) for r in shards.compare_keys(listed, stored).collect())
    assert got == [("1", "missing", 1), ("1", "stored", 1), ("2", "missing", 1), ("3", "extra", 1), ("None", "missing", 1), ("None", "stored", 1)]


def test_files_fit_their_outputs():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 300) for _ in range(rng.randint(0, 200))]
        bins = shards.packed_files(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(len(b) == 1 or sum(sizes[i] for i in b) <= 105 for b in bins)
        # plain first fit opens as many
        room = []
        for s in sorted((s for s in sizes if s <= 105), reverse=True):
            k = next((k for k, r in enumerate(room) if r >= s), None)
            if k is None:
                room.append(105 - s)
            else:
                room[k] -= s
        assert len(bins) == len(room) + sum(s > 105 for s in sizes)


def test_files_are_merged_and_cut_to_the_target(spark, tmp_path):
    df = spark.range(12_000).select("id", F.col("id").cast("string").alias("name"), F.array(*(F.rand(i) for i in range(40))).alias("x"))
    small, large = str(tmp_path / "in" / "small"), str(tmp_path / "in" / "large")
    df.where("id < 4000").repartition(20).write.option("compression", "zstd").parquet(small)
    df.where("id >= 4000").coalesce(1).write.option("compression", "zstd").parquet(large)
    source = f"{tmp_path}/in/*"
    given = shards.listed_files(spark, source)[1]
    target = sum(given) // 8
    sizes = [r["size"] for r in shards.repack_files(spark, source, str(tmp_path / "out"), target).collect()]
    assert 7 <= len(sizes) <= 10 and max(sizes) <= 1.1 * target
    back = spark.read.parquet(str(tmp_path / "out")).drop("_out")
    assert back.exceptAll(spark.read.parquet(source)).count() == 0 and back.count() == 12_000
