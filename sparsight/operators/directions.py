"""Pairs of dictionary directions that overlap, without multiplying all of them out.

The directions are turned so that their first few coordinates hold much of
their length. The product of two directions differs from that of their first
coordinates by at most the product of what is left of their lengths; only
pairs whose bound reaches the threshold are multiplied in full.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsight.functions.vectors import to_matrix
from sparsight.operators.autoencoder import MAX_BLOCK_BYTES, blocks_of
from sparsight.operators.statistics import leading_axes
from sparsight.session import materialize

AXES = 16
SLACK = 1e-9  # rounding of the bound, relative to the lengths
_CELLS_PER_STEP = 1 << 20  # pairs whose bound is computed at once inside a task
_DENSE = 4  # where more than one pair in four is left, one matrix product costs less
_KIND = "i int, j int, overlap double, pairs bigint, products bigint"


def turned(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates along orthonormal ``axes`` (width x m), and the length of the rest."""
    head = x @ axes
    return head, np.linalg.norm(x - head @ axes.T, axis=1)


def may_overlap(
    head: np.ndarray, rest: np.ndarray, heads: np.ndarray, rests: np.ndarray, min_abs: float
) -> np.ndarray:
    """Whether the product of two vectors can be ``min_abs`` or more in size; bounds that are no number count as such."""
    length, lengths = np.hypot(np.linalg.norm(head, axis=1), rest), np.hypot(np.linalg.norm(heads, axis=1), rests)
    bound = np.abs(head @ heads.T) + (rest + SLACK * length)[:, None] * (rests + SLACK * lengths)[None, :]
    bound += SLACK * length[:, None] * lengths[None, :]
    return ~(bound < min_abs)


def _overlaps(x: np.ndarray, w: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Products of the pairs in ``may``, and how many products were computed for them."""
    row, col = np.nonzero(may)
    if len(row) * _DENSE > may.size:
        return row, col, (x @ w.T)[row, col], may.size
    step = max(1, _CELLS_PER_STEP // x.shape[1])
    parts = [
        np.einsum("pd,pd->p", x[row[at : at + step]], w[col[at : at + step]]) for at in range(0, len(row), step)
    ]
    return row, col, np.concatenate([np.zeros(0), *parts]), len(row)


def close_directions(
    sae: DataFrame, min_abs: float, axes: int = AXES, max_bytes: int = MAX_BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``i, j, overlap`` as ``interference`` gives them, and ``pairs, products``: how many there are and were computed.

    Exact for any dictionary; how many products are saved depends on how much
    of the directions a few axes hold. One block of latents at a time is on the
    driver and broadcast, meets the latents below its last, and is written.
    Latents without a direction take no part; an empty dictionary has no pairs.
    """
    spark = sae.sparkSession
    rows = sae.where(F.col("w_dec").isNotNull())
    if rows.isEmpty():
        none = spark.createDataFrame([], _KIND)
        return none.select("i", "j", "overlap"), spark.createDataFrame([(0, 0)], "pairs bigint, products bigint")
    basis = leading_axes(rows, "w_dec", axes)
    parts = []
    for block in blocks_of(rows, max_bytes, ("w_dec",)):
        shared = spark.sparkContext.broadcast((block.latent, block.w_dec, *turned(block.w_dec, basis), basis))

        def run(batches, shared=shared):
            latent, w, heads, rests, axes_ = shared.value
            step = max(1, _CELLS_PER_STEP // len(latent))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    i, x = part.column("latent").to_numpy(), to_matrix(part.column("w_dec"), np.float64)
                    ours = i[:, None] < latent[None, :]
                    row, col, overlap, products = _overlaps(
                        x, w, ours & may_overlap(*turned(x, axes_), heads, rests, min_abs)
                    )
                    kept = np.abs(overlap) >= min_abs
                    n = int(kept.sum())
                    count = lambda v: pa.array([None] * n + [v], pa.int64())
                    end = lambda v, kind: pa.concat_arrays([pa.array(v[kept], kind), pa.nulls(1, kind)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            end(i[row], pa.int32()), end(latent[col], pa.int32()), end(overlap, pa.float64()),
                            count(int(ours.sum())), count(products),
                        ],
                        names=["i", "j", "overlap", "pairs", "products"],
                    )

        below = rows.where(F.col("latent") < int(block.latent[-1])).select("latent", "w_dec")
        parts.append(materialize(below.mapInArrow(run, _KIND), "close-directions"))
        shared.destroy()
    found = reduce(DataFrame.unionByName, parts)
    work = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "products")))
    return found.where(F.col("i").isNotNull()).select("i", "j", "overlap"), work
