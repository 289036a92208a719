"""Overlapping directions against all products, and how many products are spared."""

import numpy as np
import pytest
from test_autoencoder import dictionary

from sparsight.operators import autoencoder, directions


def pairs(df):
    return {(r.i, r.j): r.overlap for r in df.collect()}


def expected(w, least):
    gram = w @ w.T
    return {(i, j): gram[i, j] for i in range(len(w)) for j in range(i + 1, len(w)) if abs(gram[i, j]) >= least}


def same(got, wanted):
    return got.keys() == wanted.keys() and all(got[k] == pytest.approx(v) for k, v in wanted.items())


def unit(w):
    return w / np.linalg.norm(w, axis=1, keepdims=True)


@pytest.mark.parametrize("limit", [autoencoder.MAX_BLOCK_BYTES, 7 * (8 * 24 + 24)])
def test_pairs_are_those_of_all_products(spark, limit):
    rng = np.random.default_rng(5)
    w = unit(np.vstack([rng.normal(size=(30, 24)), np.eye(24)[:3], np.eye(24)[:2], -np.eye(24)[:1]]))
    d = dictionary(spark, w).repartition(3)
    for least in (0.0, 0.35, 1.0):
        found, work = directions.close_directions(d, least, axes=4, max_bytes=limit)
        assert same(pairs(found), expected(w, least))
        assert work.first().pairs == len(w) * (len(w) - 1) // 2


def test_lengths_count(spark):
    rng = np.random.default_rng(6)
    w = rng.normal(size=(40, 12)) * np.exp(rng.normal(0, 3, (40, 1)))
    w[7] = 0
    for least in (0.5, 40.0):
        assert same(pairs(directions.close_directions(dictionary(spark, w), least, axes=3)[0]), expected(w, least))


def test_few_axes_spare_most_products(spark):
    rng = np.random.default_rng(7)
    w = unit(rng.normal(size=(400, 8)) @ rng.normal(size=(8, 96)) + 0.05 * rng.normal(size=(400, 96)))
    found, work = directions.close_directions(dictionary(spark, w), 0.8)
    assert same(pairs(found), expected(w, 0.8))
    row = work.first()
    assert row.pairs == 400 * 399 // 2 and row.products < 0.1 * row.pairs


def test_directions_without_common_axes_are_all_multiplied(spark):
    w = unit(np.random.default_rng(8).normal(size=(120, 64)))
    found, work = directions.close_directions(dictionary(spark, w), 0.3, axes=2)
    assert same(pairs(found), expected(w, 0.3))
    assert work.first().products >= work.first().pairs


def test_empty_null_single_and_unbounded_rows(spark):
    d = dictionary(spark, np.eye(3))
    found, work = directions.close_directions(d.where("false"), 0.1)
    assert found.columns == ["i", "j", "overlap"] and found.count() == 0 and tuple(work.first()) == (0, 0)
    found, work = directions.close_directions(d.where("latent = 1"), 0.1)
    assert found.count() == 0 and tuple(work.first()) == (0, 0)
    odd = d.selectExpr("latent", "w_enc", "b_enc", "log_threshold", "if(latent = 1, null, w_dec) AS w_dec", "1 AS i", "2 AS pairs")
    assert directions.close_directions(odd, -1.0)[0].count() == 1
    far = dictionary(spark, [[np.inf, 1.0], [1.0, 1.0], [1.0, -1.0], [np.nan, 0.0]])
    got = pairs(directions.close_directions(far, 0.5)[0])
    assert got == {(0, 1): np.inf, (0, 2): np.inf}


def test_repeated_latents_repeat_their_pairs(spark):
    d = dictionary(spark, unit(np.array([[1.0, 0.1], [1.0, 0.2]])))
    twice = d.unionByName(d)
    assert directions.close_directions(twice, 0.9)[0].count() == autoencoder.interference(twice, 0.9).count() == 4
