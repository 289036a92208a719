"""Sparse autoencoder: encode, decode, losses, dictionary geometry.

A dictionary is a table (latent, w_enc, b_enc, log_threshold, w_dec), one row
per latent. Products with it run as matrix products per Arrow batch against a
broadcast block of latents; a dictionary beyond the size bound is taken block
by block, so no latent is ever left out. Of several blocks one at a time is on
the driver and broadcast: what it gives is written before the next is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparsight.functions.vectors import from_matrix, scale, squared_norm, to_matrix, unit
from sparsight.operators.statistics import products
from sparsight.session import materialize

MAX_BLOCK_BYTES = 640 << 20  # both matrices of 16,384 latents of width 2,048 are 513 MiB
MATRICES = ("w_enc", "w_dec")
_CELLS_PER_STEP = 1 << 22  # codes computed at once inside a task

TIE_DECIMALS = 9  # equal vectors must tie, though a product may differ in its last bits

SAE_SCHEMA = (
    "latent int, w_enc array<double>, b_enc double, log_threshold double, w_dec array<double>"
)
INITIAL_THRESHOLD = 0.001


def dictionary_from_vectors(
    vectors: DataFrame, latent: str = "latent", threshold: float = INITIAL_THRESHOLD
) -> DataFrame:
    """Unit decoder vectors, the encoder as their transpose, zero biases."""
    w = unit("vector")
    return vectors.select(
        F.col(latent).cast("int").alias("latent"),
        w.alias("w_enc"),
        F.lit(0.0).alias("b_enc"),
        F.log(F.lit(threshold)).alias("log_threshold"),
        w.alias("w_dec"),
    )


def sae_init(
    spark: SparkSession, d_in: int, d_sae: int, seed: int = 42,
    threshold: float = INITIAL_THRESHOLD,
) -> DataFrame:
    """A random dictionary; the numbers of a latent depend on (seed, latent) alone."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            rows = [np.random.default_rng([seed, int(i)]).normal(size=d_in) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), from_matrix(np.array(rows), pa.float64())],
                names=["latent", "vector"],
            )

    drawn = spark.range(d_sae).mapInArrow(draw, "latent long, vector array<double>")
    return dictionary_from_vectors(drawn, threshold=threshold)


def renorm(sae: DataFrame) -> DataFrame:
    """Decoder vectors back to length one."""
    return sae.withColumn("w_dec", unit("w_dec"))


@dataclass(frozen=True)
class Block:
    """Some latents of a dictionary as arrays, in latent order."""

    latent: np.ndarray
    w_enc: np.ndarray
    b_enc: np.ndarray
    theta: np.ndarray
    w_dec: np.ndarray


def collect_block(sae: DataFrame, matrices: tuple[str, ...] = MATRICES) -> Block:
    t = sae.select("latent", "b_enc", "log_threshold", *matrices).orderBy("latent").toArrow()
    if not t.num_rows:
        return Block(*[np.zeros(0)] * 5)

    def matrix(name: str) -> np.ndarray:
        if name not in matrices:
            return np.zeros((t.num_rows, 0))
        return to_matrix(t.column(name).combine_chunks())

    return Block(
        t.column("latent").to_numpy(),
        matrix("w_enc"),
        t.column("b_enc").to_numpy(),
        np.exp(t.column("log_threshold").to_numpy()),
        matrix("w_dec"),
    )


def block_ranges(
    sae: DataFrame, max_bytes: int = MAX_BLOCK_BYTES, matrices: tuple[str, ...] = MATRICES
) -> list[tuple[int, int]]:
    """First and last latent id of ranges that stay below ``max_bytes`` each, counting the named matrices."""
    lo, hi, width = sae.agg(
        F.min("latent"), F.max("latent"), F.max(F.size(matrices[0]))
    ).first()
    per_block = max(1, max_bytes // (8 * len(matrices) * width + 24))
    return [(first, first + per_block - 1) for first in range(lo, hi + 1, per_block)]


def _blocks_in(
    sae: DataFrame, ranges: list[tuple[int, int]], matrices: tuple[str, ...]
) -> Iterator[Block]:
    for first, last in ranges:
        block = collect_block(sae.where(F.col("latent").between(first, last)), matrices)
        if len(block.latent):
            yield block


def blocks_of(
    sae: DataFrame, max_bytes: int = MAX_BLOCK_BYTES, matrices: tuple[str, ...] = MATRICES
) -> Iterator[Block]:
    """The dictionary in ranges of latent ids that stay below ``max_bytes`` each.

    Only the named matrices are read and counted; others stay empty.
    """
    return _blocks_in(sae, block_ranges(sae, max_bytes, matrices), matrices)


def _per_block(
    sae: DataFrame, max_bytes: int, matrices: tuple[str, ...], label: str, of: Callable[[Broadcast], DataFrame]
) -> DataFrame:
    """What ``of`` gives for each block, together; of several blocks each is written before the next is read."""
    ranges = block_ranges(sae, max_bytes, matrices)
    parts = []
    for block in _blocks_in(sae, ranges, matrices):
        shared = sae.sparkSession.sparkContext.broadcast(block)
        part = of(shared)
        if len(ranges) > 1:
            part = materialize(part, label)
            shared.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def _code(pre: np.ndarray, theta: np.ndarray, activation: str) -> np.ndarray:
    if activation == "jumprelu":
        return np.where(pre > theta, pre, 0.0)  # strictly above the threshold
    if activation == "relu":
        return np.maximum(pre, 0.0)
    if activation == "sigmoid":
        return 1.0 / (1.0 + np.exp(-pre))
    if activation == "tanh":
        return np.tanh(pre)
    raise ValueError(f"unknown activation {activation}")


def _strongest(
    row: np.ndarray, col: np.ndarray, z: np.ndarray, ties: list[np.ndarray], k: int
) -> np.ndarray:
    """Indices of the ``k`` largest codes of every latent."""
    order = np.lexsort((*(t[row] for t in reversed(ties)), -np.round(z, TIE_DECIMALS), col))
    ordered = col[order]
    place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
    return order[place < k]


def _encode_block(
    acts: DataFrame, shared: Broadcast, b_dec: np.ndarray | None, keys: list[str],
    vector: str, activation: str, top: int | None,
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        step = max(1, _CELLS_PER_STEP // len(b.latent))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = to_matrix(part.column(vector))
                if b_dec is not None:
                    x = x - b_dec
                z = _code(x @ b.w_enc.T + b.b_enc, b.theta, activation)
                row, col = np.nonzero(z)
                if top is not None:
                    ties = [part.column(k).to_numpy(zero_copy_only=False) for k in keys]
                    best = _strongest(row, col, z[row, col], ties, top)
                    row, col = row[best], col[best]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k).take(take) for k in keys),
                        pa.array(b.latent[col], pa.int32()),
                        pa.array(z[row, col], pa.float64()),
                    ],
                    names=[*keys, "latent", "z"],
                )

    kinds = dict(acts.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "latent int", "z double"])
    return acts.select(*keys, vector).mapInArrow(run, schema)


def sae_encode(
    acts: DataFrame,
    sae: DataFrame,
    keys: list[str],
    b_dec: list[float] | None = None,
    activation: str = "jumprelu",
    vector: str = "activation",
    max_bytes: int = MAX_BLOCK_BYTES,
    top: int | None = None,
) -> DataFrame:
    """Sparse codes (keys, latent, z) of ``W (x - b_dec) + b``; no shuffle.

    Only non-zero codes become rows. ``acts`` is scanned once per block
    of latents, which is once unless the dictionary exceeds ``max_bytes``.
    ``top`` is for a search of the strongest codes: each batch of rows puts
    out no more than its own ``top`` per latent, ties in the order of the
    keys. The overall ``top`` are always among them.
    """
    bias = None if b_dec is None else np.asarray(b_dec, dtype=np.float64)
    return _per_block(
        sae, max_bytes, ("w_enc",), "codes",
        lambda shared: _encode_block(acts, shared, bias, keys, vector, activation, top),
    )


def code_sums(
    acts: DataFrame,
    sae: DataFrame,
    activations: tuple[str, ...],
    b_dec: list[float] | None = None,
    vector: str = "activation",
    max_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """(activation, latent, n, total): how many codes are not zero, and their sum.

    For functions whose codes are hardly ever zero: a task adds them up per
    latent and no code leaves it. All functions share one pass per block.
    """
    bias = None if b_dec is None else np.asarray(b_dec, dtype=np.float64)

    def of(shared: Broadcast) -> DataFrame:
        def run(batches):
            b = shared.value
            step = max(1, _CELLS_PER_STEP // len(b.latent))
            n = np.zeros((len(activations), len(b.latent)), np.int64)
            total = np.zeros(n.shape)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    x = to_matrix(batch.column(0).slice(at, step))
                    pre = (x if bias is None else x - bias) @ b.w_enc.T + b.b_enc
                    for i, name in enumerate(activations):
                        z = _code(pre, b.theta, name)
                        n[i] += np.count_nonzero(z, axis=0)
                        total[i] += z.sum(axis=0)
            i, j = np.nonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(activations, object)[i], pa.string()), pa.array(b.latent[j], pa.int32()),
                    pa.array(n[i, j]), pa.array(total[i, j]),
                ],
                names=["activation", "latent", "n", "total"],
            )

        return acts.select(vector).mapInArrow(run, "activation string, latent int, n long, total double")

    return _per_block(sae, max_bytes, ("w_enc",), "code-sums", of).groupBy("activation", "latent").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )


def _decode_block(grouped: DataFrame, shared: Broadcast, keys: list[str]) -> DataFrame:
    """The keys and codes of ``grouped``, and what the block adds to its ``reconstruction``, if it has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        step = max(1, _CELLS_PER_STEP // len(b.latent))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                codes = part.column("codes")
                row = np.repeat(
                    np.arange(len(codes)), codes.value_lengths().to_numpy(zero_copy_only=False)
                )
                cells = codes.flatten()
                latent = cells.field("latent").to_numpy(zero_copy_only=False)
                col = np.minimum(np.searchsorted(b.latent, latent), len(b.latent) - 1)
                mine = b.latent[col] == latent
                z = np.zeros((len(codes), len(b.latent)))
                values = cells.field("z").to_numpy(zero_copy_only=False)
                z[row[mine], col[mine]] = values[mine]
                decoded = z @ b.w_dec
                if "reconstruction" in part.schema.names:
                    decoded += to_matrix(part.column("reconstruction"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), from_matrix(decoded, pa.float64())],
                    names=[*kept, "reconstruction"],
                )

    kinds, kept = dict(grouped.dtypes), [*keys, "codes"]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in kept), "reconstruction array<double>"])
    return grouped.mapInArrow(run, schema)


def sae_decode(
    z: DataFrame,
    sae: DataFrame,
    keys: list[str],
    b_dec: list[float] | None = None,
    max_bytes: int = MAX_BLOCK_BYTES,
    every: DataFrame | None = None,
) -> DataFrame:
    """(keys, reconstruction) for every vector with at least one active latent.

    With ``every``, a table with the keys of all vectors, those without one are
    there as well and decode to the bias. A group holds the codes of one vector: at most as many as there are latents.
    """
    grouped = z.groupBy(*keys).agg(F.collect_list(F.struct("latent", "z")).alias("codes"))
    ranges = block_ranges(sae, max_bytes, ("w_dec",))
    decoded = grouped
    for block in _blocks_in(sae, ranges, ("w_dec",)):
        shared = sae.sparkSession.sparkContext.broadcast(block)
        decoded = _decode_block(decoded, shared, keys)
        if len(ranges) > 1:  # a written copy takes the place of the last one, without a shuffle
            decoded = materialize(decoded, "decoded")
            shared.destroy()
    decoded = decoded.drop("codes")
    if every is not None:
        width = sae.select(F.size("w_dec").alias("n")).first()["n"]
        decoded = every.select(*keys).join(decoded, keys, "left").withColumn(
            "reconstruction", F.coalesce("reconstruction", F.array_repeat(F.lit(0.0), width))
        )
    if b_dec is None:
        return decoded
    bias = F.array(*[F.lit(float(b)) for b in b_dec])
    return decoded.withColumn(
        "reconstruction", F.zip_with("reconstruction", bias, lambda x, b: x + b)
    )


def l0(z: DataFrame, n_rows: int) -> DataFrame:
    return z.agg((F.count("*") / F.lit(n_rows)).alias("l0"))


def sae_loss(
    acts: DataFrame,
    sae: DataFrame,
    keys: list[str],
    weight: float,
    b_dec: list[float] | None = None,
    vector: str = "activation",
    max_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """(n_rows, l0, reconstruction, loss): loss = reconstruction + weight * l0.

    Each batch is encoded and decoded in place. With the dictionary in one block
    only sums leave a task; of several, each adds to the error of every vector,
    which is written with the vector. No vector is shuffled.
    """
    bias = None if b_dec is None else np.asarray(b_dec, dtype=np.float64)

    def coded(batches: Iterator[pa.RecordBatch], b: Block):
        """Vectors around the bias, their number of active latents, and what they decode to."""
        step = max(1, _CELLS_PER_STEP // len(b.latent))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = to_matrix(part.column(vector))
                centred = x if bias is None else x - bias
                pre = centred @ b.w_enc.T + b.b_enc
                z = np.where(pre > b.theta, pre, 0.0)
                yield part, centred, np.count_nonzero(z, axis=1), z @ b.w_dec

    ranges = block_ranges(sae, max_bytes)
    if len(ranges) == 1:
        shared = acts.sparkSession.sparkContext.broadcast(next(_blocks_in(sae, ranges, MATRICES)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, centred, active, decoded in coded(batches, shared.value):
                error = decoded - centred  # the decoder adds the bias back
                yield pa.RecordBatch.from_pydict(
                    {
                        "n": [len(error)], "active": [int(active.sum())],
                        "squared": [float((error * error).sum())],
                    }
                )

        sums = acts.select(vector).mapInArrow(run, "n long, active long, squared double").agg(
            F.sum("n").alias("n"), F.sum("active").alias("a"), F.sum("squared").alias("s")
        )
    else:
        kind = dict(acts.dtypes)[vector]
        state = acts.select(vector)
        for block in _blocks_in(sae, ranges, MATRICES):
            shared = acts.sparkSession.sparkContext.broadcast(block)

            def add(batches, shared=shared):
                for part, centred, active, decoded in coded(batches, shared.value):
                    if "error" in part.schema.names:
                        error = to_matrix(part.column("error")) + decoded
                        active = active + part.column("active").to_numpy()
                    else:
                        error = decoded - centred
                    yield pa.RecordBatch.from_arrays(
                        [part.column(vector), from_matrix(error, pa.float64()), pa.array(active, pa.int64())],
                        names=[vector, "error", "active"],
                    )

            state = materialize(state.mapInArrow(add, f"`{vector}` {kind}, error array<double>, active bigint"), "errors")
            shared.destroy()
        sums = state.agg(
            F.count("*").alias("n"), F.sum("active").alias("a"), F.sum(squared_norm("error")).alias("s")
        )
    rec = F.col("s") / F.col("n")
    mean_active = F.col("a") / F.col("n")
    return sums.select(
        F.col("n").alias("n_rows"),
        mean_active.alias("l0"),
        rec.alias("reconstruction"),
        (rec + weight * mean_active).alias("loss"),
    )


def normalize(acts: DataFrame, rms: float, vector: str = "activation") -> DataFrame:
    return acts.withColumn(vector, scale(vector, F.lit(1.0 / rms)))


def sparsity_penalties(
    z: DataFrame, n_rows: int, rho: float = 0.05, latents: DataFrame | None = None
) -> DataFrame:
    """Per latent: mean activation, KL(rho, mean), and its L1 and L2 sums.

    With ``latents``, those that are never active have zeros and no divergence.
    """
    n = F.lit(float(n_rows))
    mean = F.sum("z") / n
    sums = z.groupBy("latent").agg(
        mean.alias("rho_j"),
        F.sum(F.abs("z")).alias("l1"),
        F.sum(F.col("z") * F.col("z")).alias("l2"),
    )
    if latents is not None:
        sums = latents.select("latent").join(sums, "latent", "left").na.fill(0.0, ["rho_j", "l1", "l2"])
    r = F.col("rho_j")
    kl = rho * F.log(rho / r) + (1 - rho) * F.log((1 - rho) / (1 - r))
    return sums.withColumn("kl", F.when((r > 0) & (r < 1), kl))


LEAST_PROBABILITY = 1e-7


def vector_losses(df: DataFrame, x: str, y: str) -> DataFrame:
    """Squared error and binary cross-entropy averaged over rows and dimensions,
    categorical cross-entropy averaged over rows. In the entropies a prediction
    counts as no nearer to 0 or 1 than ``LEAST_PROBABILITY``.
    """
    cells = df.select(
        F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("dim", "c")
    )
    a, b = F.col("c.x").cast("double"), F.col("c.y").cast("double")
    p = F.least(F.greatest(b, F.lit(LEAST_PROBABILITY)), F.lit(1 - LEAST_PROBABILITY))
    n = F.count_if(F.col("dim") == 0)
    return cells.agg(
        n.alias("n_rows"),
        F.avg((a - b) * (a - b)).alias("mse"),
        (-F.avg(a * F.log(p) + (1 - a) * F.log(1 - p))).alias("binary_ce"),
        (-F.sum(a * F.log(p)) / n).alias("categorical_ce"),
    )


def latent_density(z: DataFrame, sae: DataFrame, n_rows: int) -> DataFrame:
    """How often each latent of the dictionary is active; dead ones included."""
    counts = z.groupBy("latent").agg(F.count("*").alias("n_active"))
    return (
        sae.select("latent")
        .join(counts, "latent", "left")
        .na.fill(0, ["n_active"])
        .withColumn("density", F.col("n_active") / F.lit(n_rows))
        .withColumn("dead", F.col("n_active") == 0)
    )


def feature_strength(sae: DataFrame) -> DataFrame:
    return sae.select("latent", squared_norm("w_dec").alias("strength"))


def frobenius_norm(sae: DataFrame) -> DataFrame:
    return feature_strength(sae).agg(F.sum("strength").alias("squared_frobenius"))


def interference(
    sae: DataFrame, min_abs: float, max_bytes: int = MAX_BLOCK_BYTES
) -> DataFrame:
    """Pairs i < j of directions whose product is at least ``min_abs`` in size.

    The dictionary meets itself block by block inside the tasks; only pairs
    over the bound become rows.
    """

    def of(shared: Broadcast) -> DataFrame:
        def run(batches):
            b = shared.value
            step = max(1, _CELLS_PER_STEP // len(b.latent))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    i = part.column("latent").to_numpy()
                    overlap = to_matrix(part.column("w_dec")) @ b.w_dec.T
                    row, col = np.nonzero(
                        (np.abs(overlap) >= min_abs) & (i[:, None] < b.latent[None, :])
                    )
                    yield pa.RecordBatch.from_pydict(
                        {"i": i[row], "j": b.latent[col], "overlap": overlap[row, col]}
                    )

        return sae.select("latent", "w_dec").mapInArrow(run, "i int, j int, overlap double")

    return _per_block(sae, max_bytes, ("w_dec",), "interference", of)


def superposition(sae: DataFrame) -> DataFrame:
    """(n_latents, rank, superposed): more directions than they can span.

    Only the width x width matrix of products reaches the driver.
    """
    cells = products(sae, "w_dec").toArrow()
    i, j = cells["i"].to_numpy(), cells["j"].to_numpy()
    gram = np.zeros((i.max() + 1, j.max() + 1))
    gram[i, j] = cells["s"].to_numpy()
    rank = int(np.linalg.matrix_rank(gram, hermitian=True))
    return sae.agg(F.count("*").alias("n_latents")).select(
        "n_latents",
        F.lit(rank).cast("long").alias("rank"),
        (F.col("n_latents") > rank).alias("superposed"),
    )


def project(acts: DataFrame, direction: list[float], vector: str = "activation") -> DataFrame:
    """Coefficient of each vector on a direction, and the projected vector."""
    f = np.asarray(direction, dtype=np.float64)

    @F.arrow_udf("double")
    def coefficient(array: pa.Array) -> pa.Array:
        return pa.array(to_matrix(array) @ f / (f @ f))

    literal: Column = F.array(*[F.lit(float(v)) for v in f])
    return acts.withColumn("coefficient", coefficient(vector)).withColumn(
        "projection", scale(literal, F.col("coefficient"))
    )
