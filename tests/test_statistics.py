import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.operators import neighbours, statistics


def table(spark, x, **extra):
    names = list(extra)
    rows = [
        (i, [float(v) for v in row], *(extra[n][i] for n in names)) for i, row in enumerate(x)
    ]
    schema = "vec_id long, activation array<double>" + "".join(f", {n} int" for n in names)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(5).normal(size=(120, 6)) * [1, 2, 3, 1, 1, 1]


def test_rms(spark):
    row = statistics.rms_stats(table(spark, [[3.0, 4.0], [0.0, 0.0]])).first()
    assert row.tokens == 2
    assert row.rms == pytest.approx(math.sqrt(12.5)) and row.rms_elem == pytest.approx(2.5)


def test_running_norm_equals_the_loop(spark):
    norms = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame(list(enumerate(norms)), "batch_id long, norm double").repartition(3)
    expected = 0.0
    for v in norms:
        expected = 0.9 * expected + 0.1 * v
    row = statistics.ema_norm(df).first()
    assert row.n_batches == 5 and row.ema == pytest.approx(expected)


def test_histogram_closes_the_last_bin(spark):
    got = statistics.histogram(table(spark, [[0.0, 1.0, 2.0, 3.0, 4.0]]), 4).orderBy("bin").collect()
    assert [r.n for r in got] == [1, 1, 1, 2]
    assert [r.density for r in got] == pytest.approx([0.2, 0.2, 0.2, 0.4])
    assert got[3].upper == 4.0


def test_histograms_agree_with_numpy(spark, x):
    groups = [0 if i % 3 else 1 for i in range(len(x))]
    got = statistics.histogram_by(table(spark, x, g=groups), "g", 12).collect()
    for g in (0, 1):
        n, edges = np.histogram(x[[v == g for v in groups]], 12)
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.bin)
        assert [r.n for r in mine] == n.tolist()
        assert [r.lower for r in mine] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_equal_values(spark):
    got = statistics.histogram_by(table(spark, [[2.0, 2.0]], g=[0]), "g", 3).orderBy("bin").collect()
    assert [r.n for r in got] == [2, 0, 0]


def test_dimension_statistics(spark, x):
    got = {r.dim: r for r in statistics.dim_stats(table(spark, x), 2.0).collect()}
    for d in range(6):
        v = x[:, d]
        assert got[d].mean == pytest.approx(v.mean()) and got[d].variance == pytest.approx(v.var())
        share = (abs(v - v.mean()) > 2 * v.std()).mean()
        assert got[d].extreme_share == pytest.approx(share)
    top = statistics.top_dims(statistics.dim_stats(table(spark, x)), 2).collect()
    assert [r.dim for r in top] == [2, 1]


def test_dimension_statistics_of_uneven_and_distant_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [[float(v) for v in 1e7 + rng.normal(size=1 + i % 4)] for i in range(3000)]
    rows[5][0] = rows[9][1] = None
    rows += [None, [], [None]]
    df = spark.createDataFrame([(r,) for r in rows], "activation array<double>").repartition(7)
    got = {r.dim: r for r in statistics.dim_stats(df, 2.0).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for d, r in got.items():
        cells = [v[d] for v in rows if v is not None and len(v) > d]
        v = np.array([c for c in cells if c is not None])
        assert r.n == len(cells) and (r.lo, r.hi) == (v.min(), v.max())
        assert r["mean"] == pytest.approx(v.mean(), rel=1e-14) and r.variance == pytest.approx(v.var(), rel=1e-7)
        assert r.extreme_share == pytest.approx((abs(v - v.mean()) > 2 * v.std()).sum() / len(cells))
    empty = spark.createDataFrame([], "activation array<double>")
    assert statistics.dim_stats(empty).count() == 0


def test_correlation_with_token_presence(spark, x):
    ids = [i % 5 if i % 2 else 9 for i in range(len(x))]
    got = statistics.dim_token_corr(table(spark, x, token_id=ids)).collect()
    for r in got:
        there = np.array([t == r.token_id for t in ids], dtype=float)
        assert r["corr"] == pytest.approx(np.corrcoef(x[:, r.dim], there)[0, 1])
    assert len(got) == 6 * len(set(ids))


def test_pca_agrees_with_numpy(spark, x):
    df = table(spark, x)
    cov = np.cov(x.T)
    cells = {(r.i, r.j): r["cov"] for r in statistics.covariance(df).collect()}
    for (i, j), v in cells.items():
        assert v == pytest.approx(cov[i, j])
    model = statistics.pca_fit(df, 2)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert model.explained_ratio == pytest.approx(values[:2] / values.sum())
    projected = statistics.pca_project(df, model).orderBy("vec_id").collect()
    p = np.array([r.projection for r in projected])
    assert p == pytest.approx((x - x.mean(axis=0)) @ model.components.T)
    assert p.var(axis=0, ddof=1) == pytest.approx(values[:2])


def test_clusters_and_outliers(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 0.1, (40, 3)), rng.normal(8, 0.1, (40, 3))
    far = np.array([[0.0, 0.0, 3.0]])
    df = statistics.cluster(table(spark, np.vstack([a, b, far])), 2)
    rows = df.collect()
    left = {r.cluster for r in rows if r.vec_id < 40}
    assert len(left) == 1 and left != {r.cluster for r in rows if 40 <= r.vec_id < 80}
    assert [r.vec_id for r in statistics.outliers(df, 4.0).collect()] == [80]


def test_layers_and_progress(spark, x):
    layer = [i % 2 for i in range(len(x))]
    got = {r.layer: r for r in statistics.compare_layers(table(spark, x, layer=layer)).collect()}
    assert got[1].tokens == 60 and got[1].hi == pytest.approx(x[1::2].max())
    df, seen = statistics.observed(table(spark, x, batch_id=layer), "rows")
    assert {r.n_rows for r in statistics.batch_progress(df).collect()} == {60}
    assert seen.get["n_rows"] == 120


def test_neighbours_broadcast_and_blocks(spark, x):
    v = np.vstack([x, x[:30]])  # copies tie
    df = table(spark, v)
    similarity = np.round(v @ v.T, 9)
    np.fill_diagonal(similarity, -np.inf)
    expected = []
    for i in range(len(v)):
        order = sorted(range(len(v)), key=lambda j: (-similarity[i, j], j))[:4]
        expected += [(i, j, rank + 1) for rank, j in enumerate(order)]
    for kwargs in ({}, {"max_bytes": 10, "block_rows": 32}):
        got = neighbours.knn(df, 4, **kwargs).collect()
        assert sorted((r.id, r.neighbour, r["rank"]) for r in got) == sorted(expected)


def test_more_neighbours_than_rows(spark):
    got = neighbours.knn(table(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]), 9)
    assert got.groupBy("id").agg(F.count("*").alias("n")).where("n <> 2").count() == 0


def test_clusters_from_given_starts(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [10.0, 0.0]), (4, [12.0, 0.0]), (5, [6.0, 0.0]), (5, [6.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, activation array<float>")
    starts = spark.createDataFrame(
        [(7, [1.0, 0.0]), (3, [11.0, 0.0]), (5, [99.0, 99.0])], "cluster int, centroid array<double>"
    )
    got = statistics.cluster_from(df, starts, 0).collect()
    assert {(r.vec_id, r.cluster) for r in got} == {(1, 7), (2, 7), (3, 3), (4, 3), (5, 3)}  # the tie goes to 3
    moved = {(r.vec_id, r.cluster, r.distance) for r in statistics.cluster_from(df, starts, 1).collect()}
    # centroids 1 and 8.5; that of cluster 5 has no vector and stays
    assert moved == {(1, 7, 1.0), (2, 7, 1.0), (3, 3, 1.5), (4, 3, 3.5), (5, 3, 2.5)}
    assert statistics.cluster_from(df.limit(0), starts, 2).collect() == []


def _nearest(rows, k):
    out = []
    for i, x in rows:
        near = sorted((-round(float(np.dot(x, y)), 9), j) for j, y in rows if j != i)[:k]
        out += [(i, j, round(-s, 7), r + 1) for r, (s, j) in enumerate(near)]
    return sorted(out)


def test_balls_give_the_exact_neighbours(spark):
    from sparsight.operators.balls import knn_balls

    rng = np.random.default_rng(3)
    middles = rng.normal(0, 5, (12, 8))
    clustered = [(i, (middles[i % 12] + rng.normal(0, 0.3, 8)).tolist()) for i in range(600)]
    clustered += [(1000 + i, clustered[5][1]) for i in range(300)]  # one vector very often
    spread = [(i, rng.normal(0, 1, 8).tolist()) for i in range(200)] + [(900, [0.0] * 8)]
    for rows, share in ((clustered, 0.6), (spread, 1.0), (spread[:3], 1.0)):
        df = spark.createDataFrame([*rows, (5000, None)], "vec_id bigint, activation array<double>").repartition(4)
        got, visits = knn_balls(df, 5, piece_rows=20)
        found = sorted((r.id, r.neighbour, round(r.similarity, 7), r.rank) for r in got.collect())
        assert found == _nearest(rows, 5)
        pairs = [(r.q, r.c) for r in visits.collect()]
        pieces = len({q for q, _ in pairs})
        assert len(set(pairs)) == len(pairs) <= share * pieces**2
    empty = df.where("false")
    assert knn_balls(empty, 5)[0].count() == 0


def test_balls_rule_out_most_pairs_of_clustered_vectors(spark):
    from sparsight.operators.balls import knn_balls

    rng = np.random.default_rng(4)
    middles = rng.normal(0, 1, (40, 16))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    rows = [(i, (10 * middles[i % 40] + rng.normal(0, 0.05, 16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id bigint, activation array<double>")
    got, visits = knn_balls(df, 3, piece_rows=20)
    pairs = visits.count()
    pieces = visits.select("q").distinct().count()
    assert pairs < 0.1 * pieces**2
    from sparsight.operators.neighbours import knn

    columns = ["id", "neighbour", "rank"]
    assert got.select(columns).exceptAll(knn(df, 3).select(columns)).count() == 0


def test_wide_pca_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 20)) * np.linspace(1, 4, 20) + 50
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, activation array<double>")
    a, b = statistics.pca_fit(df, 3), statistics.pca_fit_wide(df, 3)
    assert a.explained_ratio == pytest.approx(b.explained_ratio, rel=1e-9) and a.mean == pytest.approx(b.mean)
    assert np.abs(a.components - b.components).max() < 1e-5
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(10)], "vec_id long, activation array<double>")
    assert statistics.pca_fit_wide(flat, 1).explained_ratio == pytest.approx([1.0])
    with pytest.raises(ValueError, match="two vectors"):
        statistics.pca_fit_wide(df.limit(1))


def test_wide_pca_beyond_the_width_of_a_covariance(spark):
    rng = np.random.default_rng(7)
    width = 9_000
    way = np.zeros((2, width))
    way[0, ::2], way[1, 1::2] = 1, 1
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    x = rng.normal(size=(40, 2)) * [30, 10] @ way + 0.01 * rng.normal(size=(40, width))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, activation array<double>")
    with pytest.raises(ValueError, match="exceeds"):
        statistics.pca_fit(df, 2)
    model = statistics.pca_fit_wide(df, 2)
    centred = x - x.mean(axis=0)
    exact = np.linalg.svd(centred, compute_uv=False) ** 2
    assert model.explained_ratio == pytest.approx(exact[:2] / exact.sum(), rel=1e-7)
