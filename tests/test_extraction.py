import numpy as np
import pytest

from sparsight.functions import vectors as vx
from sparsight.plans import flows
from sparsight.operators import extraction, packing, tokens

ROWS = [(1, [0, 5, 9, 1]), (2, [0, 6, 7, 8, 1]), (3, [0, 1]), (4, [0] + list(range(2, 40)) + [1])]


def blocks(spark, size=8, **kwargs):
    df = spark.createDataFrame(ROWS, "doc_id long, seq array<int>")
    return packing.pack(df, size, **kwargs)


def network(kept=(0,), width=8, ids=11):
    """A table of vectors per layer, looked up by id."""
    table = np.random.default_rng(3).normal(0, 0.4, (2, ids, width))

    def model(tokens):
        whole = table[list(kept)][:, tokens % ids]
        return whole if len(kept) > 1 else whole[0]

    model.table = table
    return model


EXPECTED = {(d, p): t for d, s in ROWS for p, t in enumerate(s) if t not in (0, 1)}


def test_model_job_against_a_loop(spark):
    net = network((1,))
    aligned = extraction.align_blocks(blocks(spark, keep_tail=True))
    rows = extraction.succeeded(extraction.extract_activations(aligned, net, rows_per_call=2)).collect()
    assert {(r.doc_id, r.tok_pos): r.token_id for r in rows} == EXPECTED
    for r in rows:
        assert r.activation == pytest.approx(net.table[1, r.token_id % 11], rel=1e-5, abs=1e-6)


def test_several_layers_in_one_run(spark):
    net = network((0, 1))
    aligned = extraction.align_blocks(blocks(spark, keep_tail=True))
    rows = extraction.extract_activations(aligned, net, layers=(0, 1)).collect()
    assert {(r.layer, r.doc_id, r.tok_pos) for r in rows} == {(k, *at) for k in (0, 1) for at in EXPECTED}
    for r in rows:
        assert r.activation == pytest.approx(net.table[r.layer, r.token_id % 11], rel=1e-5, abs=1e-6)


def test_rows_are_numbered_before_the_run(spark, tmp_path):
    from sparsight.sources import shards

    aligned = extraction.number_rows(extraction.align_blocks(blocks(spark, keep_tail=True)))
    rows = extraction.extract_activations(aligned, network())
    shards.write_shards(shards.name_shards(rows.drop("error"), "row_id", 7), str(tmp_path / "s"), clustered=True)
    stored = spark.read.parquet(str(tmp_path / "s")).orderBy("row_id").collect()
    assert [r.row_id for r in stored] == list(range(len(EXPECTED)))
    assert [(r.doc_id, r.tok_pos) for r in stored] == sorted(EXPECTED)
    assert all(r.split == f"train_{r.row_id // 7:05d}" for r in stored)


def test_tokens_are_numbered_from_the_lengths(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, seq array<int>").repartition(3)
    lengths = spark.createDataFrame([(d, len(q)) for d, q in ROWS], "doc_id long, n_tokens int")
    rows = sorted((r.row_id, r.doc_id, r.tok_pos, r.token_id) for r in extraction.number_tokens(df, lengths).collect())
    assert rows == [(i, d, p, EXPECTED[d, p]) for i, (d, p) in enumerate(sorted(EXPECTED))]


def test_stored_layers_and_what_they_lack(spark):
    rows = spark.createDataFrame([(b, 1, i, t) for b, t in enumerate([[2, 3], [5, 6], [4, 12]]) for i, t in enumerate(t)],
                                 "block_id long, doc_id long, tok_pos int, token_id int")
    layers = spark.createDataFrame([(k, i, [float(k), float(i)]) for k in (0, 1) for i in range(5)], "layer int, vec_id long, activation array<double>")
    got = sorted((r.layer, r.token_id, r.activation) for r in extraction.layer_activations(rows, layers, 5, 2).collect())
    assert got == sorted((k, t, [float(k), float(t % 5)]) for k in (0, 1) for t in (2, 3, 5, 6, 4, 12))
    nan = float("nan")
    stored = spark.createDataFrame([(0, [1.0, 2.0]), (1, [nan, 1.0]), (2, [1.0]), (3, [1.0, 1.0])], "vec_id long, activation array<double>")
    lacking = extraction.unusable_vectors(stored, 5, 2)
    assert sorted(map(tuple, lacking.collect())) == [(1, "not finite"), (2, "wrong width"), (4, "no vector")]
    told = extraction.quarantine(rows, lacking, 5)
    assert sorted((r.block_id, r.error) for r in extraction.failed(told).distinct().collect()) == [
        (0, "wrong width"), (1, "not finite"), (2, "no vector")]
    fine = extraction.quarantine(rows, lacking.where("vec_id = 4"), 5)
    assert sorted(r.token_id for r in extraction.succeeded(fine).collect()) == [2, 3, 5, 6]


def test_chunks_keep_true_positions(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, seq array<int>")
    aligned = extraction.align_chunks(tokens.chunk(df, 4, keep_tail=True))
    rows = extraction.extract_activations(aligned, network()).collect()
    assert {(r.doc_id, r.tok_pos): r.token_id for r in rows} == {
        (d, p): t for d, s in ROWS for p, t in enumerate(s) if t not in (0, 1)
    }


def failing_model():
    def model(ids):
        if (ids == 7).any():
            raise MemoryError("too big")
        return np.zeros((*ids.shape, 2))

    return model


def test_quarantine_loses_only_the_failing_block(spark):
    aligned = extraction.align_blocks(blocks(spark, 4, keep_tail=True))
    rows = extraction.extract_activations(aligned, failing_model(), on_error="quarantine")
    stream = [t for _, seq in ROWS for t in seq]
    parts = [stream[i : i + 4] for i in range(0, len(stream), 4)]
    bad = extraction.failed(rows).collect()
    assert {r.block_id for r in bad} == {i for i, part in enumerate(parts) if 7 in part}
    assert {r.error for r in bad} == {"MemoryError: too big"}
    kept = sum(t not in (0, 1) for part in parts if 7 not in part for t in part)
    assert extraction.succeeded(rows).count() == kept


def test_errors_are_raised_by_default(spark):
    aligned = extraction.align_blocks(blocks(spark, 4))
    with pytest.raises(Exception, match="too big"):
        extraction.extract_activations(aligned, failing_model()).collect()


def test_matrices_to_rows(spark):
    df = spark.createDataFrame(
        [(1, [0, 5, 1], [[0.0, 0.0], [1.0, 2.0], [9.0, 9.0]])],
        "doc_id long, ids array<int>, activacion array<array<float>>",
    )
    (row,) = extraction.activation_rows(df).collect()
    assert (row.doc_id, row.tok_pos, row.token_id, row.activation) == (1, 1, 5, [1.0, 2.0])
    assert extraction.explode_matrix(df).count() == 3


def test_bf16_codes(spark):
    values = [1.0, -2.0, 0.0, 0.15625]
    df = spark.createDataFrame([(values,), (None,), ([],)], "activation array<float>")
    coded = extraction.compact_bf16(df)
    got = [r.activation for r in coded.collect()]
    assert got == [[16256, 49152, 0, 15904], None, []]
    assert [r.activation for r in extraction.expand_bf16(coded).collect()] == [values, None, []]


@pytest.mark.parametrize("codec", ["bf16", "fp16"])
def test_codecs_round_to_nearest(spark, codec):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=500) * 10.0 ** rng.integers(-4, 4, 500)).astype(np.float32)
    df = spark.createDataFrame([([float(v) for v in x],)], "activation array<float>")
    pack, unpack = {
        "bf16": (extraction.compact_bf16, extraction.expand_bf16),
        "fp16": (extraction.compact_f16, extraction.expand_f16),
    }[codec]
    back = np.array(unpack(pack(df)).first().activation, dtype=np.float32)
    if codec == "fp16":
        assert (back == x.astype(np.float16).astype(np.float32)).all()
    else:
        assert (np.abs(back - x) <= np.abs(x) * 2.0**-8).all()
    twice = np.array(unpack(pack(unpack(pack(df)))).first().activation, dtype=np.float32)
    assert (twice == back).all()


def test_bf16_specials():
    import pyarrow as pa

    x = pa.array([float("inf"), float("-inf"), float("nan"), 1e-40, 3.4e38], pa.float32())
    assert vx._bf16_codes(x)[:3].tolist() == [0x7F80, 0xFF80, 0x7FC0]


def test_compaction_report(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 1.001]), ("a", [2.0, 0.0])], "split string, activation array<float>"
    )
    row = extraction.compaction_report(df).first()
    assert (row.n_rows, row.bytes_float, row.bytes_codes) == (2, 16, 8)
    assert 0 < row.max_error < 2.0**-8


def test_lookup_takes_token_modulo(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 4)], "doc_id long, tok_pos int, token_id int")
    table = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0])], "vec_id long, activation array<float>")
    got = extraction.lookup_activations(rows, table, 1).orderBy("tok_pos").collect()
    assert [r.activation for r in got] == [[2.0], [1.0]]
    assert got[0].asDict().keys() == {"doc_id", "tok_pos", "token_id", "activation"}


def test_layers_come_from_the_model(spark):
    """Rows of the corpus hold what the gated layers give, computed here in plain code, not the given vectors."""
    folder = "/root/testdata/sf0.001"
    sae = flows.dictionary(spark, folder).orderBy("latent").collect()
    w = np.array([r.w_enc for r in sae])
    gated = lambda x, gate, up: (x @ gate.T / (1 + np.exp(-(x @ gate.T))) * (x @ up.T)) @ w
    first = gated(w, w, w[::-1])
    second = gated(w + first, w[::-1], w)
    table, n = flows.mlp_layers(spark, folder, (0, 1))
    assert n == len(w) and table.count() == 2 * n
    for r in table.collect():
        assert np.allclose(r.activation, (first, second)[r.layer][r.vec_id], atol=1e-5)
    rows = flows.mlp_rows(spark, folder, (1,)).limit(200).collect()
    assert all(np.allclose(r.activation, second[r.token_id % n], atol=1e-5) for r in rows)


def test_the_model_runs_over_the_packed_blocks(spark, monkeypatch):
    """A model whose vectors tell of the whole block: rows made from one run per id would not hold them."""
    folder = "/root/testdata/sf0.001"

    def telling(embedding, layers, kept):
        def model(ids):
            before = np.cumsum(ids, axis=1) % 1009
            whole = np.stack([np.stack([before + k, np.full_like(ids, ids.shape[1])], axis=-1) for k in kept])
            return whole if len(kept) > 1 else whole[0]

        model.embedding = embedding
        return model

    monkeypatch.setattr(extraction, "GatedMlp", telling)
    aligned = extraction.align_blocks(flows.blocks(spark, folder, keep_tail=True)).collect()
    wanted = {
        (d, p): (t, [float(c % 1009 + 1), float(len(b.ids))])
        for b in aligned for d, p, t, c in zip(b.docs, b.positions, b.ids, np.cumsum(b.ids)) if t not in (0, 1)
    }
    rows = flows.mlp_rows(spark, folder, (1,)).collect()
    assert {(r.doc_id, r.tok_pos): (r.token_id, r.activation) for r in rows} == wanted and len(rows) == len(wanted)
    both = flows.mlp_rows(spark, folder, (0, 1), {"sum": lambda x: x.sum(axis=1)}).collect()
    assert len(both) == 2 * len(wanted)
    assert all(r["sum"] == sum(wanted[r.doc_id, r.tok_pos][1]) - 1 + r.layer for r in both)


def test_every_token_goes_through_the_gated_layers():
    """Outputs of the layers, in the order asked for, over more tokens than one stretch takes."""
    w = np.random.default_rng(5).normal(0, 0.5, (7, 4))
    ids = np.arange(2, 2 + 3 * 200).reshape(3, 200)
    x = w[ids % 7]
    gated = lambda x, gate, up: (x @ gate.T / (1 + np.exp(-(x @ gate.T))) * (x @ up.T)) @ w
    first = gated(x, w, w[::-1])
    second = gated(x + first, w[::-1], w)
    layers = ((w, w[::-1], w), (w[::-1], w, w))
    assert np.allclose(extraction.GatedMlp(w, layers, (1, 0))(ids), np.stack([second, first]))
    assert np.allclose(extraction.GatedMlp(w, layers, (1,))(ids), second)


def test_sequences_numbered_and_stored_where_they_are_made(spark, tmp_path):
    """Documents in blocks of three tokens: rows keep their numbers, their order and the bytes of their vectors."""
    from sparsight.sources import shards

    df = spark.createDataFrame(ROWS, "doc_id long, seq array<int>").repartition(3)
    lengths = spark.createDataFrame([(d, len(q)) for d, q in ROWS], "doc_id long, n_tokens int")
    aligned = extraction.align_sequences(extraction.number_sequences(df, lengths), 3)
    net = network((1,))
    made = extraction.extract_activations(aligned, net, as_bytes=True, rows_per_call=2)
    named = shards.name_shards(extraction.succeeded(made).drop("block_id"), "row_id", 5)
    shards.write_shards(named, str(tmp_path / "s"), clustered=True, steps=("row_id", "tok_pos"))
    stored = spark.read.parquet(str(tmp_path / "s")).withColumn("activation", vx.f32_bytes_to_floats("activation"))
    rows = stored.orderBy("row_id").collect()
    assert [(r.row_id, r.doc_id, r.tok_pos, r.token_id) for r in rows] == [
        (i, d, p, EXPECTED[d, p]) for i, (d, p) in enumerate(sorted(EXPECTED))]
    assert all(r.split == f"train_{r.row_id // 5:05d}" for r in rows)
    for r in rows:
        assert r.activation == pytest.approx(net.table[1, r.token_id % 11], rel=1e-6, abs=1e-6)


def test_the_dataset_is_stored_whole_and_small(spark, tmp_path):
    """Every token has its vector; 256 bytes of floats each, of which equal vectors of a file share one."""
    from sparsight.sources import shards

    folder, path = "/root/testdata/sf0.001", str(tmp_path / "dataset")
    stored = flows.activation_dataset(spark, folder, path, 30_000)
    words = sum(len(r.seq) - 2 for r in flows.sequences(spark, folder).collect())
    rows = stored.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(words))
    assert {r.split for r in rows} == {f"train_{i // 30_000:05d}" for i in range(words)}
    table, n = flows.mlp_layers(spark, folder, (0,))
    vectors = {r.vec_id: r.activation for r in table.collect()}
    assert all(np.allclose(r.activation, vectors[r.token_id % n], atol=1e-6) for r in rows[::101])
    assert sum(shards.listed_files(spark, path)[1]) < 8 * words  # 39 bytes a row before


def test_bytes_of_floats(spark):
    x = np.random.default_rng(2).normal(size=(5, 3)).astype(np.float32)
    data = [(i, bytearray(v.tobytes())) for i, v in enumerate(x)] + [(5, None), (6, bytearray())]
    df = spark.createDataFrame(data, "i int, b binary").coalesce(1).select("i", vx.f32_bytes_to_floats("b").alias("v"))
    got = {r.i: r.v for r in df.collect()}
    assert got[5] is None and got[6] == [] and all(got[i] == x[i].tolist() for i in range(5))
    parts = df.where("i < 5").select("i", vx.vector_parts("v").alias("p")).select("i", "p.*").collect()
    for r in parts:
        v = x[r.i].astype(float)
        assert (r["first"], r.total, r.sq) == pytest.approx((v[0], v.sum(), (v * v).sum()))
    with pytest.raises(Exception, match="another width"):
        df.select(vx.vector_parts("v")).collect()


def test_rows_are_written_by_the_worker_that_makes_them(spark, tmp_path):
    from sparsight.sources import shards

    df = spark.createDataFrame(ROWS, "doc_id long, seq array<int>").repartition(3)
    lengths = spark.createDataFrame([(d, len(q)) for d, q in ROWS], "doc_id long, n_tokens int")
    aligned = extraction.align_sequences(extraction.number_sequences(df, lengths), 4)
    keep = ("doc_id", "tok_pos", "token_id", "row_id", "activation")
    run, _ = extraction.activation_run(network(), as_bytes=True, numbered=True)
    shards.write_shards(aligned, str(tmp_path / "a"), clustered=True, through=shards.named_batches(run, "row_id", 5, keep))
    made = extraction.extract_activations(aligned, network(), as_bytes=True)
    shards.write_shards(shards.name_shards(made.select(*keep), "row_id", 5), str(tmp_path / "b"), clustered=True)
    a, b = (spark.read.parquet(str(tmp_path / x)).orderBy("row_id") for x in "ab")
    assert a.collect() == b.collect() and a.count() == len(EXPECTED)
    with pytest.raises(ValueError, match="clustered"):
        shards.write_shards(aligned, str(tmp_path / "c"), through=run)


def test_names_of_shards(spark):
    from sparsight.sources import shards

    df = spark.createDataFrame([(i,) for i in (0, 9, 10, 999_999, 1_000_000, 12_345_678)], "n long")
    assert [r.split for r in shards.name_shards(df, "n", 10).orderBy("n").collect()] == [
        f"train_{i:05d}" for i in (0, 0, 1, 99_999, 100_000, 1_234_567)]
