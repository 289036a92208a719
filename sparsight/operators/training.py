"""Training the sparse autoencoder: one Spark job per step.

The training table is written once in the order of a hashed key, so a step
reads the row groups of its key ranges and nothing else. Tasks add up gradients of
their rows; the sums meet on the executors per group of latents, and only one
gradient, as large as the parameters, reaches the driver for the update.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparsight.functions.vectors import from_matrix, to_matrix
from sparsight.operators.autoencoder import (
    INITIAL_THRESHOLD, SAE_SCHEMA, Block, blocks_of, sae_init,
)
from sparsight.operators.ordering import Permutation
from sparsight.session import materialize

# Fixed values of the training recipe.
MAX_LR = 7e-5
THRESHOLD_LR_FACTOR = 3.5
BETAS = (0.0, 0.999)
THRESHOLD_BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8
BANDWIDTH = 0.001
WARMUP_STEPS = 2_000
SPARSITY_WARMUP_STEPS = 10_000
TOTAL_STEPS = 32_000
MAX_SPARSITY = 0.0005
BATCH_ROWS = 1_024
LOG_EVERY = 500

_MAX_PARAMETER_BYTES = 2 << 30
_MIX = 8  # key ranges that make up a batch
_GROUP_CELLS = 1 << 20  # gradient numbers that meet in one reducing group


@dataclass(frozen=True)
class FitConfig:
    d_sae: int
    total_steps: int = TOTAL_STEPS
    batch_rows: int = BATCH_ROWS
    warmup_steps: int = WARMUP_STEPS
    sparsity_warmup_steps: int = SPARSITY_WARMUP_STEPS
    max_lr: float = MAX_LR
    max_sparsity: float = MAX_SPARSITY
    bandwidth: float = BANDWIDTH
    threshold: float = INITIAL_THRESHOLD
    expected_norm: float | None = None
    seed: int = 42


@dataclass
class Fit:
    sae: DataFrame
    b_dec: list[float]
    log: DataFrame
    steps: int = field(default=0)


def schedule(spark: SparkSession, cfg: FitConfig) -> DataFrame:
    """(step, lr, sparsity_weight) of every step.

    The rate rises in a line during the warm-up and then falls along half a
    cosine; the weight of the sparsity rises in a line and stays.
    """
    step = F.col("id").cast("double")
    done = (step - cfg.warmup_steps) / max(1, cfg.total_steps - cfg.warmup_steps)
    rate = F.when(step < cfg.warmup_steps, (step + 1) / max(1, cfg.warmup_steps)).otherwise(
        (F.cos(done * math.pi) + 1) / 2
    )
    weight = F.least(F.lit(1.0), (step + 1) / max(1, cfg.sparsity_warmup_steps))
    return spark.range(cfg.total_steps).select(
        F.col("id").cast("int").alias("step"), (rate * cfg.max_lr).alias("lr"),
        (weight * cfg.max_sparsity).alias("sparsity_weight"),
    )


def gradients(x: np.ndarray, p: Block, b_dec: np.ndarray, weight: float, bandwidth: float) -> dict:
    """Sums over the rows of ``x``, to be divided by the batch size.

    The threshold gradient is the straight-through estimate: non-zero only
    where the rectified pre-activation is within half a bandwidth of it.
    """
    centred = x - b_dec
    pre = centred @ p.w_enc.T + p.b_enc
    mask = pre > p.theta
    z = np.where(mask, pre, 0.0)
    error = z @ p.w_dec + b_dec - x
    d_xhat = 2.0 * error
    d_z = d_xhat @ p.w_dec.T
    d_pre = d_z * mask
    near = np.abs(np.maximum(pre, 0.0) - p.theta) < bandwidth / 2
    d_theta = -(near * (d_z * pre + weight)).sum(axis=0) / bandwidth
    return {
        "w_enc": d_pre.T @ centred,
        "b_enc": d_pre.sum(axis=0),
        "log_threshold": d_theta * p.theta,
        "w_dec": z.T @ d_xhat,
        "b_dec": d_xhat.sum(axis=0) - d_pre.sum(axis=0) @ p.w_enc,
        "scalars": np.array([(error * error).sum(), float(mask.sum()), float(len(x))]),
    }


def _packed(g: dict) -> np.ndarray:
    """One row per latent, and a last row for what belongs to none."""
    m, d = g["w_enc"].shape
    out = np.zeros((m + 1, 2 * d + 2))
    out[:m, :d], out[:m, d : 2 * d] = g["w_enc"], g["w_dec"]
    out[:m, 2 * d], out[:m, 2 * d + 1] = g["b_enc"], g["log_threshold"]
    out[m, :d], out[m, d : d + 3] = g["b_dec"], g["scalars"]
    return out


def _step_gradient(
    batch: DataFrame, params: Block, b_dec: np.ndarray, norm: float, weight: float,
    bandwidth: float,
) -> np.ndarray:
    m, d = params.w_enc.shape
    width = 2 * d + 2
    per_group = max(1, _GROUP_CELLS // width)
    shared = batch.sparkSession.sparkContext.broadcast((params, b_dec))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, bias = shared.value
        total = None
        for rows in batches:
            if not rows.num_rows:
                continue
            x = to_matrix(rows.column(0)) / norm
            g = _packed(gradients(x, p, bias, weight, bandwidth))
            total = g if total is None else total + g
        if total is not None:
            for at in range(0, m + 1, per_group):
                piece = total[at : at + per_group].tobytes()
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "g": [piece]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(g) for g in group["g"])
        return pd.DataFrame({"at": [int(group["at"].iloc[0])], "g": [total.tobytes()]})

    summed = (
        batch.mapInArrow(partial, "at int, g binary")
        .groupBy("at")
        .applyInPandas(add, "at int, g binary")
        .toArrow()
    )
    shared.destroy()
    out = np.zeros((m + 1, width))
    for at, g in zip(summed["at"].to_pylist(), summed["g"].to_pylist()):
        piece = np.frombuffer(g).reshape(-1, width)
        out[at : at + len(piece)] = piece
    return out


class _Adam:
    def __init__(self, shape, betas):
        self.m, self.v, self.t, self.betas = np.zeros(shape), np.zeros(shape), 0, betas

    def update(self, grad: np.ndarray, lr: float) -> np.ndarray:
        b1, b2 = self.betas
        self.t += 1
        self.m = b1 * self.m + (1 - b1) * grad
        self.v = b2 * self.v + (1 - b2) * grad * grad
        m_hat, v_hat = self.m / (1 - b1**self.t), self.v / (1 - b2**self.t)
        return -lr * m_hat / (np.sqrt(v_hat) + ADAM_EPS)


def sorted_rows(acts: DataFrame, keys: list[str], vector: str, seed: int) -> DataFrame:
    """(key, x), written in the order of a hash of seed and keys, so that ranges of it are random rows."""
    hashed = acts.select(F.xxhash64(F.lit(seed), *keys).alias("key"), F.col(vector).alias("x"))
    return materialize(hashed.repartitionByRange("key").sortWithinPartitions("key"), "training")


def key_range(part: int, parts: int) -> tuple[int, int]:
    """First and last key of one of ``parts`` equal ranges of all 64-bit keys."""
    cut = lambda i: -(1 << 63) + (i << 64) // parts
    return cut(part), cut(part + 1) - 1


def batch_filter(step: int, batches: int, seed: int, mix: int = _MIX) -> Column:
    """The rows of a step: ``mix`` key ranges, dealt anew every epoch."""
    epoch, within = divmod(step, batches)
    if batches == 1:
        return F.lit(True)
    order = Permutation.of(batches * mix, seed, epoch)
    wanted = F.lit(False)
    for i in range(within * mix, within * mix + mix):
        low, high = key_range(order.at(i), batches * mix)
        wanted = wanted | F.col("key").between(low, high)
    return wanted


def _save_state(spark: SparkSession, path: str, step: int, values: dict, adam: dict, log: list) -> None:
    """The state after ``step`` updates; one row per latent and parameter."""
    names, at, columns = [], [], {"value": [], "m": [], "v": []}
    for name, value in values.items():
        parts = [np.atleast_2d(a) for a in (value, adam[name].m, adam[name].v)]
        names += [name] * len(parts[0])
        at += range(len(parts[0]))
        for column, part in zip(columns.values(), parts):
            column += part.tolist()
    numbers = {k: pa.array(v, pa.list_(pa.float64())) for k, v in columns.items()}
    state = pa.table({"name": names, "at": pa.array(at, pa.int32()), **numbers})
    # the log first: a state that is marked as whole has its log
    log_table(spark, log).write.mode("overwrite").parquet(f"{path}/log-{step:08d}")
    spark.createDataFrame(state).write.mode("overwrite").parquet(f"{path}/state-{step:08d}")


def _last_state(spark: SparkSession, path: str) -> int | None:
    """The number of updates of the newest state that was written to its end."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state-*/_SUCCESS")
    store = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(pattern)
    steps = [int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found or []]
    return max(steps, default=None)


def _load_state(spark: SparkSession, path: str, step: int, values: dict, adam: dict) -> list[tuple]:
    """Puts a saved state into ``values`` and ``adam``; returns its log."""
    rows = spark.read.parquet(f"{path}/state-{step:08d}").orderBy("name", "at").toPandas()
    for name, part in rows.groupby("name"):
        shape = values[name].shape
        values[name], adam[name].m, adam[name].v = (
            np.array(part[c].tolist()).reshape(shape) for c in ("value", "m", "v")
        )
        adam[name].t = step
    return [tuple(r) for r in spark.read.parquet(f"{path}/log-{step:08d}").orderBy("step").collect()]


def sae_fit(
    acts: DataFrame,
    cfg: FitConfig,
    keys: tuple[str, ...] = ("vec_id",),
    vector: str = "activation",
    initial: DataFrame | None = None,
    checkpoint: str | None = None,
    every: int = LOG_EVERY,
) -> Fit:
    """Minibatch training; exactly ``cfg.total_steps`` updates.

    A step takes a few ranges of a hashed key, dealt anew every epoch, and reads
    the row groups that hold them. ``keys`` name a row, so that ranges are
    random rows, about ``cfg.batch_rows`` in all.

    With ``checkpoint``, a folder that all share, the state is saved there
    every ``every`` steps and at the end. A run with the same table and
    settings goes on from the newest whole state; steps without rows count.
    """
    spark = acts.sparkSession
    table = sorted_rows(acts, list(keys), vector, cfg.seed)
    batches = max(1, table.count() // cfg.batch_rows)
    width = table.select(F.size("x").alias("n")).first()["n"]
    if (2 * width + 2) * cfg.d_sae * 8 > _MAX_PARAMETER_BYTES:
        raise ValueError("parameters exceed what the driver may hold")
    start = initial or sae_init(spark, width, cfg.d_sae, cfg.seed, cfg.threshold)
    (p,) = blocks_of(start, _MAX_PARAMETER_BYTES)
    norm = cfg.expected_norm
    if norm is None:
        squares = table.select(F.explode("x").alias("v")).agg(
            F.sum(F.col("v").cast("double") * F.col("v"))
        )
        norm = math.sqrt(squares.first()[0] / table.count())

    now = {
        "w_enc": p.w_enc.copy(), "b_enc": p.b_enc.copy(), "w_dec": p.w_dec.copy(),
        "b_dec": np.zeros(width), "log_threshold": np.log(p.theta),
    }
    adam = {
        name: _Adam(value.shape, THRESHOLD_BETAS if name == "log_threshold" else BETAS)
        for name, value in now.items()
    }
    log: list[tuple] = []
    done = _last_state(spark, checkpoint) if checkpoint else None
    if done is not None:
        log = _load_state(spark, checkpoint, done, now, adam)
    m, d = now["w_enc"].shape
    planned = schedule(spark, cfg).orderBy("step").collect()  # one row per step
    for step, rate, weight in planned[done or 0 :]:
        batch = table.where(batch_filter(step, batches, cfg.seed))
        params = Block(p.latent, now["w_enc"], now["b_enc"], np.exp(now["log_threshold"]), now["w_dec"])
        g = _step_gradient(batch.select("x"), params, now["b_dec"], norm, weight, cfg.bandwidth)
        squared, active, n = g[m, d : d + 3]
        if n:
            g /= n
            d_dec = g[:m, d : 2 * d]
            d_dec = d_dec - (d_dec * now["w_dec"]).sum(axis=1, keepdims=True) * now["w_dec"]
            slopes = {
                "w_enc": g[:m, :d], "b_enc": g[:m, 2 * d], "w_dec": d_dec, "b_dec": g[m, :d],
                "log_threshold": g[:m, 2 * d + 1],
            }
            for name, slope in slopes.items():
                own = THRESHOLD_LR_FACTOR * rate if name == "log_threshold" else rate
                now[name] = now[name] + adam[name].update(slope, own)
            now["w_dec"] = now["w_dec"] / np.linalg.norm(now["w_dec"], axis=1, keepdims=True)
        else:
            for moments in adam.values():
                moments.t += 1
        rows = max(n, 1.0)
        rec, mean_active = squared / rows, active / rows
        log.append(
            (step, int(n), float(rec), float(mean_active), float(rec + weight * mean_active),
             float(rate), float(weight))
        )
        if checkpoint and ((step + 1) % every == 0 or step + 1 == cfg.total_steps):
            _save_state(spark, checkpoint, step + 1, now, adam, log)
    sae = _parameters(
        spark, p.latent, now["w_enc"], now["b_enc"], now["log_threshold"], now["w_dec"]
    )
    return Fit(sae, [float(b) for b in now["b_dec"]], log_table(spark, log), cfg.total_steps)


def save_dictionary(fit: Fit, path: str) -> None:
    """A trained dictionary and its bias, as Parquet."""
    fit.sae.write.mode("overwrite").parquet(f"{path}/latents")
    bias = fit.sae.sparkSession.createDataFrame([(fit.b_dec,)], "b_dec array<double>")
    bias.write.mode("overwrite").parquet(f"{path}/bias")


def load_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, list[float]]:
    """What ``save_dictionary`` has written."""
    bias = spark.read.parquet(f"{path}/bias").first()["b_dec"]
    return spark.read.schema(SAE_SCHEMA).parquet(f"{path}/latents"), list(bias)


def _parameters(spark: SparkSession, latent, w_enc, b_enc, log_theta, w_dec) -> DataFrame:
    table = pa.table(
        {
            "latent": pa.array(latent, pa.int32()),
            "w_enc": from_matrix(w_enc, pa.float64()), "b_enc": b_enc,
            "log_threshold": log_theta, "w_dec": from_matrix(w_dec, pa.float64()),
        }
    )
    return spark.createDataFrame(table, SAE_SCHEMA)


def log_table(spark: SparkSession, log: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        log,
        "step int, n_rows int, reconstruction double, l0 double, loss double, "
        "lr double, sparsity_weight double",
    )


def summarise_log(log: DataFrame, every: int = LOG_EVERY) -> DataFrame:
    return log.groupBy(F.expr(f"step div {int(every)}").alias("period")).agg(
        F.min("step").alias("first_step"),
        F.count("*").alias("steps"),
        F.avg("reconstruction").alias("reconstruction"),
        F.avg("l0").alias("l0"),
        F.avg("loss").alias("loss"),
    )
