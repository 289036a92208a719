import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight.operators import autoencoder as sae
from sparsight.operators import sharded_training, training
from sparsight.operators.autoencoder import Block


def dictionary(spark, w, theta=0.5, b_enc=None):
    rows = [
        (i, [float(v) for v in r], float(b_enc[i]) if b_enc is not None else 0.0,
         math.log(theta), [float(v) for v in r])
        for i, r in enumerate(w)
    ]
    return spark.createDataFrame(rows, sae.SAE_SCHEMA)


def acts(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, activation array<double>")


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(7)
    w = rng.normal(size=(13, 5))
    return rng.normal(size=(60, 5)), w / np.linalg.norm(w, axis=1, keepdims=True)


def test_fixture_of_two_latents(spark):
    x, d = acts(spark, [[1.0, 0.2], [0.4, 0.4]]), dictionary(spark, np.eye(2))
    z = sae.sae_encode(x, d, ["vec_id"])
    assert [(r.vec_id, r.latent, r.z) for r in z.collect()] == [(0, 0, 1.0)]
    assert sae.l0(z, 2).first().l0 == 0.5
    row = sae.sae_loss(x, d, ["vec_id"], 0.0005).first()
    assert row.reconstruction == pytest.approx(0.18) and row.loss == pytest.approx(0.18025)


def test_threshold_is_strict(spark):
    x = acts(spark, [[0.5], [0.51], [-1.0]])
    d = dictionary(spark, [[1.0]], theta=0.5)
    z = sae.sae_encode(x, d, ["vec_id"]).collect()
    assert [(r.vec_id, round(r.z, 9)) for r in z] == [(1, 0.51)]


def test_blocks_of_a_large_dictionary_change_nothing(spark, case):
    x, w = case
    bias = [0.1, -0.2, 0.0, 0.3, 0.05]
    df, d = acts(spark, x), dictionary(spark, w, 0.3)
    small = 16 * 5 * 4  # three latents per block
    assert len(list(sae.blocks_of(d, small))) == 5
    whole = sae.sae_encode(df, d, ["vec_id"], bias)
    parts = sae.sae_encode(df, d, ["vec_id"], bias, max_bytes=small)
    one = {(r.vec_id, r.latent): r.z for r in whole.collect()}
    two = {(r.vec_id, r.latent): r.z for r in parts.collect()}
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(v) for k, v in one.items())
    pre = (x - bias) @ w.T
    assert one.keys() == {(i, j) for i, j in zip(*np.nonzero(pre > 0.3))}
    hat = np.where(pre > 0.3, pre, 0.0) @ w + bias
    for limit in (sae.MAX_BLOCK_BYTES, small):
        decoded = sae.sae_decode(whole, d, ["vec_id"], bias, limit).collect()
        for r in decoded:
            assert r.reconstruction == pytest.approx(hat[r.vec_id].tolist())
        row = sae.sae_loss(df, d, ["vec_id"], 0.01, bias, max_bytes=limit).first()
        assert row.reconstruction == pytest.approx(((hat - x) ** 2).sum(axis=1).mean())
        assert row.l0 == pytest.approx((pre > 0.3).sum() / len(x)) and row.n_rows == len(x)


def test_gaps_in_latent_ids(spark, case):
    x, w = case
    d = dictionary(spark, w, 0.3).withColumn("latent", F.col("latent") * 1000)
    z = sae.sae_encode(acts(spark, x), d, ["vec_id"], max_bytes=16 * 5 * 900)
    assert z.select("latent").distinct().where("latent % 1000 <> 0").count() == 0
    assert z.count() == int(((x @ w.T) > 0.3).sum())


@pytest.mark.parametrize("name", ["relu", "sigmoid", "tanh"])
def test_other_codes(spark, case, name):
    x, w = case
    pre = x @ w.T
    expected = {"relu": np.maximum(pre, 0), "sigmoid": 1 / (1 + np.exp(-pre)), "tanh": np.tanh(pre)}[name]
    z = sae.sae_encode(acts(spark, x), dictionary(spark, w), ["vec_id"], activation=name)
    got = np.zeros_like(pre)
    for r in z.collect():
        got[r.vec_id, r.latent] = r.z
    assert got == pytest.approx(expected)


def test_dictionary_start(spark):
    d = sae.sae_init(spark, 6, 9)
    rows = d.orderBy("latent").collect()
    assert [r.latent for r in rows] == list(range(9))
    for r in rows:
        assert np.linalg.norm(r.w_dec) == pytest.approx(1.0) and r.w_enc == r.w_dec
        assert math.exp(r.log_threshold) == pytest.approx(0.001) and r.b_enc == 0.0
    again = sae.sae_init(spark, 6, 9).repartition(3).orderBy("latent").collect()
    assert again == rows
    longer = d.withColumn("w_dec", F.transform("w_dec", lambda v: v * 3))
    assert sae.renorm(longer).orderBy("latent").first().w_dec == pytest.approx(rows[0].w_dec)


def test_penalties_density_and_losses(spark):
    z = spark.createDataFrame([(0, 0.5), (0, 0.5), (1, -0.3)], "latent int, z double")
    got = {r.latent: r for r in sae.sparsity_penalties(z, 10, 0.05).collect()}
    assert got[0].rho_j == pytest.approx(0.1) and got[0].kl == pytest.approx(0.016707, abs=1e-6)
    assert (got[0].l1, got[0].l2) == (1.0, 0.5) and got[1].kl is None
    d = dictionary(spark, np.eye(3))
    density = {r.latent: (r.n_active, r.dead) for r in sae.latent_density(z, d, 10).collect()}
    assert density == {0: (2, False), 1: (1, False), 2: (0, True)}
    pairs = spark.createDataFrame([([1.0, 0.0], [0.5, 0.25])], "x array<double>, y array<double>")
    row = sae.vector_losses(pairs, "x", "y").first()
    assert row.mse == pytest.approx((0.25 + 0.0625) / 2)
    assert row.binary_ce == pytest.approx(-(math.log(0.5) + math.log(0.75)) / 2)
    assert row.categorical_ce == pytest.approx(-math.log(0.5))


def test_geometry(spark, case):
    x, w = case
    d = dictionary(spark, w)
    gram = w @ w.T
    expected = {(i, j) for i in range(13) for j in range(i + 1, 13) if abs(gram[i, j]) >= 0.4}
    for limit in (sae.MAX_BLOCK_BYTES, 16 * 5 * 4):
        got = {(r.i, r.j): r.overlap for r in sae.interference(d, 0.4, limit).collect()}
        assert got.keys() == expected
        assert all(v == pytest.approx(gram[k]) for k, v in got.items())
    row = sae.superposition(d).first()
    assert (row.n_latents, row["rank"], row.superposed) == (13, 5, True)
    assert not sae.superposition(dictionary(spark, np.eye(4)[:3])).first().superposed
    assert sae.frobenius_norm(d).first().squared_frobenius == pytest.approx(13.0)
    f = np.array([1.0, 2.0, 0.0, -1.0, 0.5])
    got = sae.project(acts(spark, x), f.tolist()).orderBy("vec_id").collect()
    assert [r.coefficient for r in got] == pytest.approx((x @ f / (f @ f)).tolist())
    assert got[0].projection == pytest.approx((x[0] @ f / (f @ f) * f).tolist())


def test_schedules(spark):
    cfg = training.FitConfig(d_sae=1)
    rows = training.schedule(spark, cfg)
    at = {r.step: r for r in rows.where("step in (0, 1999, 2000, 9999, 17000, 20000, 31999)").collect()}
    assert rows.count() == 32000
    share = {k: v.lr / training.MAX_LR for k, v in at.items()}
    assert share[0] == pytest.approx(0.0005) and share[1999] == share[2000] == pytest.approx(1.0)
    assert share[17000] == pytest.approx(0.5) and share[31999] == pytest.approx(0.0, abs=1e-6)
    assert at[0].sparsity_weight == pytest.approx(5e-8)
    assert at[9999].sparsity_weight == at[20000].sparsity_weight == pytest.approx(0.0005)


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(3)
    m, d, n = 4, 3, 12
    p = {
        "w_enc": rng.normal(size=(m, d)), "b_enc": rng.normal(size=m) * 0.1,
        "w_dec": rng.normal(size=(m, d)), "b_dec": rng.normal(size=d) * 0.1,
    }
    x, theta = rng.normal(size=(n, d)), np.full(m, 0.2)

    def block(q):
        return Block(np.arange(m), q["w_enc"], q["b_enc"], theta, q["w_dec"])

    def loss(q):
        pre = (x - q["b_dec"]) @ q["w_enc"].T + q["b_enc"]
        return (((pre * (pre > theta)) @ q["w_dec"] + q["b_dec"] - x) ** 2).sum()

    g = training.gradients(x, block(p), p["b_dec"], 0.0005, 0.001)
    for name in p:
        for at in np.ndindex(p[name].shape):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += 1e-6
            up = loss(q)
            q[name][at] -= 2e-6
            assert g[name][at] == pytest.approx((up - loss(q)) / 2e-6, rel=1e-4, abs=1e-5)
    assert g["scalars"][0] == pytest.approx(loss(p)) and g["scalars"][2] == n


def test_threshold_gradient_only_near_the_threshold():
    w = np.eye(1)
    b = Block(np.arange(1), w, np.zeros(1), np.array([0.5]), w)
    weight = 0.1
    for value, near in [(0.5004, True), (0.4996, True), (0.502, False), (-0.5, False)]:
        x = np.array([[value]])
        g = training.gradients(x, b, np.zeros(1), weight, 0.001)["log_threshold"][0]
        z = value if value > 0.5 else 0.0
        expected = -(2 * (z - value) * value + weight) / 0.001 * 0.5 if near else 0.0
        assert g == pytest.approx(expected)


def test_training(spark):
    rng = np.random.default_rng(0)
    true = np.abs(rng.normal(size=(6, 8)))
    x = np.maximum(rng.normal(size=(400, 6)), 0) @ true
    cfg = training.FitConfig(
        d_sae=16, total_steps=10, batch_rows=100, warmup_steps=2, sparsity_warmup_steps=4,
        max_lr=2e-2,
    )
    fit = training.sae_fit(acts(spark, x), cfg)
    log = fit.log.orderBy("step").collect()
    assert [r.step for r in log] == list(range(10))
    assert log[-1].reconstruction < 0.7 * log[0].reconstruction
    assert sum(r.n_rows for r in log[:4]) == 400  # an epoch takes every row once
    for r in fit.sae.collect():
        assert np.linalg.norm(r.w_dec) == pytest.approx(1.0)
    summary = training.summarise_log(fit.log, 5).orderBy("period").collect()
    assert [(r.first_step, r.steps) for r in summary] == [(0, 5), (5, 5)]


def test_a_step_reads_its_share_only(spark, tmp_path):
    n = 4_000
    df = spark.range(n).select(F.xxhash64(F.lit(42), "id").alias("key"), F.array(F.col("id").cast("double")).alias("x"))
    path = str(tmp_path / "rows")
    # small row groups, as many rows as a batch has
    df.repartitionByRange(4, "key").sortWithinPartitions("key").write.option("parquet.block.size", 1024).option(
        "parquet.block.row.count.limit", 100).parquet(path)
    table = spark.read.parquet(path)
    batches = 10
    seen = []
    for step in range(batches):
        batch = table.where(training.batch_filter(step, batches, 42))
        plan = batch._jdf.queryExecution().executedPlan()
        assert "PushedFilters: [" in plan.toString() and "GreaterThanOrEqual(key" in plan.toString()
        seen += [r.x[0] for r in batch.collect()]
        read = plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
        batch._jdf.queryExecution().executedPlan()
        assert read <= n // 2
    assert sorted(seen) == list(range(n))  # an epoch takes every row once
    other = [r.x[0] for r in table.where(training.batch_filter(batches, batches, 42)).collect()]
    assert set(other) != set(seen[: len(other)])
    ends = [training.key_range(i, 7) for i in range(7)]
    assert ends[0][0] == -(2**63) and ends[-1][1] == 2**63 - 1 and all(a[1] + 1 == b[0] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("per_shard", [1, 3, 100])
def test_sharded_training_is_training(spark, per_shard):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    cfg = training.FitConfig(
        d_sae=7, total_steps=3, batch_rows=90, warmup_steps=2, sparsity_warmup_steps=3, max_lr=1e-2, bandwidth=0.2, threshold=0.1
    )
    whole = training.sae_fit(acts(spark, x), cfg)
    parts = sharded_training.sharded_fit(acts(spark, x), cfg, per_shard=per_shard)
    for a, b in zip(whole.sae.orderBy("latent").collect(), parts.sae.orderBy("latent").collect()):
        assert a.w_enc == pytest.approx(b.w_enc) and a.w_dec == pytest.approx(b.w_dec)
        assert (a.latent, a.b_enc, a.log_threshold) == pytest.approx((b.latent, b.b_enc, b.log_threshold))
    assert whole.b_dec == pytest.approx(parts.b_dec)
    for a, b in zip(whole.log.orderBy("step").collect(), parts.log.orderBy("step").collect()):
        assert tuple(a) == pytest.approx(tuple(b))


def test_sharded_training_over_parts_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(sharded_training, "_PIECES", 1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    cfg = training.FitConfig(d_sae=4, total_steps=1, batch_rows=40, warmup_steps=1, sparsity_warmup_steps=1, max_lr=1e-2, bandwidth=0.2, threshold=0.1)
    parts = sharded_training.sharded_fit(acts(spark, x), cfg, per_shard=2)
    whole = training.sae_fit(acts(spark, x), cfg)
    assert whole.b_dec == pytest.approx(parts.b_dec)
    with pytest.raises(ValueError, match="no rows"):
        sharded_training.sharded_fit(acts(spark, x).where("false"), cfg)


def test_strongest_per_batch_hold_the_strongest_of_all(spark, case):
    from sparsight.operators.latents import top_activations

    x, w = case
    rows = [(i % 7, i, [float(v) for v in x[i % 20]]) for i in range(200)]  # many ties
    df = spark.createDataFrame(rows, "doc_id long, tok_pos int, activation array<double>")
    d = dictionary(spark, w, 0.2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        whole = top_activations(sae.sae_encode(df, d, ["doc_id", "tok_pos"]), 3)
        few = sae.sae_encode(df, d, ["doc_id", "tok_pos"], top=3)
        a = sorted((r.latent, r["rank"], r.doc_id, r.tok_pos) for r in whole.collect())
        b = sorted((r.latent, r["rank"], r.doc_id, r.tok_pos) for r in top_activations(few, 3).collect())
        assert a == b and few.count() < sae.sae_encode(df, d, ["doc_id", "tok_pos"]).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_training_goes_on_from_a_saved_state(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    cfg = training.FitConfig(
        d_sae=7, total_steps=6, batch_rows=20, warmup_steps=2, sparsity_warmup_steps=3, max_lr=1e-2
    )
    whole = training.sae_fit(acts(spark, x), cfg)
    path = str(tmp_path / "run")
    training.sae_fit(acts(spark, x), cfg, checkpoint=path, every=2)
    # as if lost after the fourth step, while a fifth state was being written
    for part in tmp_path.glob("run/state-00000006/*SUCCESS"):
        part.unlink()
    assert training._last_state(spark, path) == 4
    again = training.sae_fit(acts(spark, x), cfg, checkpoint=path, every=2)
    rows = lambda fit: fit.sae.orderBy("latent").collect()
    for a, b in zip(rows(whole), rows(again)):
        assert a.w_enc == pytest.approx(b.w_enc) and a.w_dec == pytest.approx(b.w_dec)
        assert (a.b_enc, a.log_threshold) == pytest.approx((b.b_enc, b.log_threshold))
    assert whole.b_dec == pytest.approx(again.b_dec)
    assert [r.step for r in again.log.orderBy("step").collect()] == list(range(6))
    training.save_dictionary(again, str(tmp_path / "saved"))
    sae, bias = training.load_dictionary(spark, str(tmp_path / "saved"))
    assert bias == again.b_dec and sae.orderBy("latent").collect() == rows(again)


def test_code_sums_are_those_of_the_codes(spark, case):
    x, d = acts(spark, case[0]), dictionary(spark, case[1])
    for bound in (1 << 20, 400):  # one block, and several
        got = {
            (r.activation, r.latent): (r.n, r.total)
            for r in sae.code_sums(x, d, ("relu", "tanh"), max_bytes=bound).collect()
        }
        for name in ("relu", "tanh"):
            z = sae.sae_encode(x, d, ["vec_id"], activation=name)
            for r in z.groupBy("latent").agg(F.count("*").alias("n"), F.sum("z").alias("t")).collect():
                n, total = got.pop((name, r.latent))
                assert n == r.n and total == pytest.approx(r.t)
        assert not got


def test_several_blocks_shuffle_no_vector(spark, case):
    x, w = case
    df, d = acts(spark, x), dictionary(spark, w, 0.3)
    small = 16 * 5 * 4
    loss = sae.sae_loss(df, d, ["vec_id"], 0.01, max_bytes=small)
    plan = loss._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    z = sae.sae_encode(df, d, ["vec_id"], max_bytes=small)
    decoded = sae.sae_decode(z, d, ["vec_id"], max_bytes=small)
    assert decoded.columns == ["vec_id", "reconstruction"]
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    hat = np.where(x @ w.T > 0.3, x @ w.T, 0.0) @ w
    assert all(r.reconstruction == pytest.approx(hat[r.vec_id].tolist()) for r in decoded.collect())
