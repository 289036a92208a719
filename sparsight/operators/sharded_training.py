"""Training of a sparse autoencoder whose parameters never meet in one place.

The state is a table with one row per range of latents: its parameters and their
moments. A step moves the rows of its batch to the ranges, adds up the parts of
their reconstructions, moves the errors back, and every range updates itself. The
driver sees three numbers per step. The training table is written once in the
order of a hashed key; a batch is a few ranges of that key, so that a step reads
the row groups that hold them and nothing else.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsight.functions.vectors import from_matrix, to_matrix
from sparsight.operators.autoencoder import SAE_SCHEMA, Block, sae_init
from sparsight.operators.training import (
    ADAM_EPS, BETAS, THRESHOLD_BETAS, THRESHOLD_LR_FACTOR, Fit, FitConfig, batch_filter, log_table, schedule,
    sorted_rows,
)
from sparsight.session import materialize

STATE_BYTES = 64 << 20  # of a range: parameters and moments
PIECE_BYTES = 1 << 20  # of rows that move together
_PIECES = 16  # pieces that meet a range in one task
BIAS = -1  # the row of the state that holds the decoder's bias

_STATE = "shard int, latents array<int>, value binary, m binary, v binary, n bigint, squared double, active double"
_NAMES = ("w_enc", "w_dec", "b_enc", "log_threshold")


# --- the state


def start_state(sae: DataFrame, width: int, per_shard: int) -> DataFrame:
    """Ranges of latents, each with zero moments, and the zero bias."""

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("latent")
        whole = np.concatenate([
            np.stack(rows.column(c).to_pylist()).ravel() if c.startswith("w_") else rows.column(c).to_numpy() for c in _NAMES
        ]).astype(np.float64)
        return _state_row(rows.column("shard")[0].as_py(), rows.column("latent").to_pylist(), whole, np.zeros_like(whole), np.zeros_like(whole))

    shards = sae.withColumn("shard", F.floor(F.col("latent") / per_shard).cast("int"))
    zero = np.zeros(width)
    bias = sae.sparkSession.createDataFrame(_state_row(BIAS, [], zero, zero, zero), _STATE)
    return shards.groupBy("shard").applyInArrow(gather, _STATE).unionByName(bias)


def _state_row(shard: int, latents: list, value, m, v, n: int = 0, squared: float = 0.0, active: float = 0.0) -> pa.Table:
    return pa.table({
        "shard": pa.array([shard], pa.int32()), "latents": pa.array([latents], pa.list_(pa.int32())),
        "value": pa.array([value.tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary()),
        "v": pa.array([v.tobytes()], pa.binary()), "n": pa.array([n], pa.int64()),
        "squared": pa.array([squared], pa.float64()), "active": pa.array([active], pa.float64()),
    })


def _parts(raw: np.ndarray, m: int, d: int) -> dict[str, np.ndarray]:
    ends = np.cumsum([0, m * d, m * d, m, m])
    out = {name: raw[a:b] for name, a, b in zip(_NAMES, ends[:-1], ends[1:])}
    return {k: x.reshape(m, d) if k.startswith("w_") else x for k, x in out.items()}


def _block(row: dict, d: int) -> Block:
    p = _parts(np.frombuffer(row["value"]), len(row["latents"]), d)
    return Block(np.array(row["latents"], np.int32), p["w_enc"], p["b_enc"], np.exp(p["log_threshold"]), p["w_dec"])


def _moved(value, m, v, slope, rate, betas, step: int):
    """Adam: the new values and moments."""
    b1, b2 = betas
    m, v = b1 * m + (1 - b1) * slope, b2 * v + (1 - b2) * slope * slope
    return value - rate * (m / (1 - b1**step)) / (np.sqrt(v / (1 - b2**step)) + ADAM_EPS), m, v


# --- one step


def _pieces(batch: DataFrame, norm: float) -> DataFrame:
    """(piece, x): the rows of a batch in matrices of bounded bytes; a task numbers its own."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for rows in batches:
            if not rows.num_rows:
                continue
            x = to_matrix(rows.column("x"), np.float64) / norm
            each = max(1, PIECE_BYTES // (8 * x.shape[1]))
            for at in range(0, len(x), each):
                yield pa.RecordBatch.from_pydict({"piece": pa.array([number], pa.int64()), "x": [x[at : at + each].tobytes()]})
                number += 1

    return batch.select("x").mapInArrow(run, "piece bigint, x binary")


def _met(state: DataFrame, pieces: DataFrame, shards: list[int]):
    """State rows and pieces grouped by range of latents and part of the batch."""
    parts = max(1, -(-pieces.count() // _PIECES))
    rows = pieces.select(
        "*", F.pmod(F.xxhash64("piece"), F.lit(parts)).cast("int").alias("part"), F.explode(F.array(*map(F.lit, shards))).alias("shard")
    )
    held = state.where(F.col("shard") != BIAS).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return held.groupBy("shard", "part"), rows.groupBy("shard", "part")


def _step(state: DataFrame, batch: DataFrame, shards: list[int], d: int, norm: float, rate: float, weight: float, bandwidth: float, step: int) -> DataFrame:
    """The state after a step on ``batch``; the bias row holds rows, squared error and active latents of the step."""
    bias = state.where(F.col("shard") == BIAS).select("shard", F.col("value").alias("bias"))
    # bias: one vector
    pieces = materialize(_pieces(batch, norm).withColumn("shard", F.lit(BIAS)).join(F.broadcast(bias), "shard").drop("shard"), "pieces")
    first = shards[0]

    def reconstruct(held: pa.Table, rows: pa.Table) -> pa.Table:
        p = _block(held.to_pylist()[0], d)
        out, active = [], []
        for raw, b in zip(rows.column("x").to_pylist(), rows.column("bias").to_pylist()):
            pre = (np.frombuffer(raw).reshape(-1, d) - np.frombuffer(b)) @ p.w_enc.T + p.b_enc
            z = np.where(pre > p.theta, pre, 0.0)
            out.append((z @ p.w_dec).tobytes())
            active.append(float((pre > p.theta).sum()))
        return pa.table({"piece": rows.column("piece"), "hat": pa.array(out, pa.binary()), "active": pa.array(active, pa.float64())})

    def error(rows: pa.Table, hats: pa.Table) -> pa.Table:
        x, b = (np.frombuffer(rows.column(c)[0].as_py()) for c in ("x", "bias"))
        total = sum(np.frombuffer(h) for h in hats.column("hat").to_pylist()).reshape(-1, d) + b - x.reshape(-1, d)
        return rows.append_column("error", pa.array([total.tobytes()], pa.binary())).append_column(
            "active", pa.array([sum(hats.column("active").to_pylist())], pa.float64())
        )

    def slope(held: pa.Table, rows: pa.Table) -> pa.Table:
        row = held.to_pylist()[0]
        p, m = _block(row, d), len(row["latents"])
        g, g_bias, told = np.zeros(2 * m * d + 2 * m), np.zeros(d), np.zeros(3)
        for r in rows.to_pylist():
            centred, e = np.frombuffer(r["x"]).reshape(-1, d) - np.frombuffer(r["bias"]), np.frombuffer(r["error"]).reshape(-1, d)
            pre = centred @ p.w_enc.T + p.b_enc
            mask = pre > p.theta
            d_z = 2.0 * e @ p.w_dec.T
            d_pre = d_z * mask
            near = np.abs(np.maximum(pre, 0.0) - p.theta) < bandwidth / 2
            d_theta = -(near * (d_z * pre + weight)).sum(axis=0) / bandwidth
            g += np.concatenate([
                (d_pre.T @ centred).ravel(), (np.where(mask, pre, 0.0).T @ (2.0 * e)).ravel(), d_pre.sum(axis=0), d_theta * p.theta,
            ])
            g_bias -= d_pre.sum(axis=0) @ p.w_enc
            if row["shard"] == first:
                g_bias += 2.0 * e.sum(axis=0)
                told += len(e), (e * e).sum(), r["active"]
        return pa.table({
            "shard": pa.array([row["shard"], BIAS], pa.int32()), "g": pa.array([g.tobytes(), g_bias.tobytes()], pa.binary()),
            "n": pa.array([0, int(told[0])], pa.int64()), "squared": pa.array([0.0, told[1]]), "active": pa.array([0.0, told[2]]),
        })

    def update(held: pa.Table, slopes: pa.Table) -> pa.Table:
        row = held.to_pylist()[0]
        n, m = rows_of_step, len(row["latents"])
        value, one, two = (np.frombuffer(row[c]) for c in ("value", "m", "v"))
        told = [sum(slopes.column(c).to_pylist()) for c in ("n", "squared", "active")]
        if not slopes.num_rows or not n:
            return _state_row(row["shard"], row["latents"], value, one, two)
        g = sum(np.frombuffer(x) for x in slopes.column("g").to_pylist()) / n
        if row["shard"] == BIAS:
            return _state_row(BIAS, [], *_moved(value, one, two, g, rate, BETAS, step), *told)
        now, first_m, second_m, grad = (_parts(x, m, d) for x in (value, one, two, g))
        along = (grad["w_dec"] * now["w_dec"]).sum(axis=1, keepdims=True) * now["w_dec"]
        grad["w_dec"] = grad["w_dec"] - along
        moved = {}
        for name in _NAMES:
            own = (THRESHOLD_LR_FACTOR * rate, THRESHOLD_BETAS) if name == "log_threshold" else (rate, BETAS)
            moved[name] = _moved(now[name], first_m[name], second_m[name], grad[name], *own, step)
        w = moved["w_dec"][0]
        moved["w_dec"] = (w / np.linalg.norm(w, axis=1, keepdims=True), *moved["w_dec"][1:])
        return _state_row(row["shard"], row["latents"], *(np.concatenate([moved[k][i].ravel() for k in _NAMES]) for i in range(3)))

    held, dealt = _met(state, pieces, shards)
    hats = held.cogroup(dealt).applyInArrow(reconstruct, "piece bigint, hat binary, active double")
    errors = materialize(pieces.groupBy("piece").cogroup(hats.groupBy("piece")).applyInArrow(
        error, "piece bigint, x binary, bias binary, error binary, active double"
    ), "errors")
    held, dealt = _met(state, errors, shards)
    slopes = held.cogroup(dealt).applyInArrow(slope, "shard int, g binary, n bigint, squared double, active double")
    rows_of_step = errors.agg(F.sum(F.octet_length("x") / (8 * d)).cast("bigint")).first()[0] or 0
    return materialize(state.groupBy("shard").cogroup(slopes.groupBy("shard")).applyInArrow(update, _STATE), "state")


def sharded_fit(
    acts: DataFrame, cfg: FitConfig, keys: tuple[str, ...] = ("vec_id",), vector: str = "activation",
    initial: DataFrame | None = None, per_shard: int | None = None,
) -> Fit:
    """As ``sae_fit``, with the parameters kept in ranges of ``per_shard`` latents on the executors.

    A step takes the rows of a few key ranges, about ``cfg.batch_rows``; it is
    written, so a lost executor costs a part of it. The result is the table of
    the dictionary and the bias, whose width is that of one vector.
    """
    spark = acts.sparkSession
    table = sorted_rows(acts, list(keys), vector, cfg.seed)
    n, width = table.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no rows to train on")
    norm = cfg.expected_norm
    if norm is None:
        squares = table.select(F.explode("x").alias("v")).agg(F.sum(F.col("v").cast("double") * F.col("v")))
        norm = math.sqrt(squares.first()[0] / n)
    start = initial or sae_init(spark, width, cfg.d_sae, cfg.seed, cfg.threshold)
    each = per_shard or max(1, STATE_BYTES // (24 * (2 * width + 2)))
    state = materialize(start_state(start, width, each), "state")
    shards = sorted(r[0] for r in state.select("shard").collect() if r[0] != BIAS)  # numbers of the ranges
    batches, log = max(1, n // cfg.batch_rows), []
    for step, rate, weight in schedule(spark, cfg).orderBy("step").collect():
        batch = table.where(batch_filter(step, batches, cfg.seed))
        state = _step(state, batch, shards, width, norm, rate, weight, cfg.bandwidth, step + 1)
        rows, squared, active = state.where(F.col("shard") == BIAS).select("n", "squared", "active").first()
        rec, l0 = squared / max(rows, 1), active / max(rows, 1)
        log.append((step, int(rows), rec, l0, rec + weight * l0, float(rate), float(weight)))
    bias = np.frombuffer(state.where(F.col("shard") == BIAS).select("value").first()[0])
    return Fit(dictionary_of(state, width), bias.tolist(), log_table(spark, log), cfg.total_steps)


def dictionary_of(state: DataFrame, width: int) -> DataFrame:
    """The table of latents that a state holds."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                p = _parts(np.frombuffer(row["value"]), len(row["latents"]), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["latents"], pa.int32()), from_matrix(p["w_enc"], pa.float64()), pa.array(p["b_enc"]),
                     pa.array(p["log_threshold"]), from_matrix(p["w_dec"], pa.float64())],
                    ["latent", "w_enc", "b_enc", "log_threshold", "w_dec"],
                )

    return state.where(F.col("shard") != BIAS).select("latents", "value").mapInArrow(run, SAE_SCHEMA)
