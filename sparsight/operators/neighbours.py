"""Exact nearest vectors by inner product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparsight.functions.vectors import to_matrix

MAX_BROADCAST_BYTES = 256 << 20
_CELLS_PER_STEP = 1 << 23  # similarities held at once inside a task
_DECIMALS = 9  # equal vectors must tie in whichever order they are summed

_SCHEMA = "id long, neighbour long, similarity double"


def best_of(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int):
    """The k best of ``others`` (ascending) for each of ``ids``; ties go to the smaller id."""
    similarity = np.round(x @ y.T, _DECIMALS)
    similarity[ids[:, None] == others[None, :]] = -np.inf
    k = min(k, len(others))
    bound = np.partition(similarity, len(others) - k, axis=1)[:, len(others) - k]
    row, col = np.nonzero((similarity >= bound[:, None]) & np.isfinite(similarity))
    value = similarity[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    return ids[row[kept]], others[col[kept]], value[kept]


def knn(
    vectors: DataFrame,
    k: int,
    key: str = "vec_id",
    column: str = "activation",
    max_bytes: int = MAX_BROADCAST_BYTES,
    block_rows: int | None = None,
) -> DataFrame:
    """(id, neighbour, similarity, rank): the ``k`` nearest others of each vector.

    A table that fits ``max_bytes`` is broadcast, each task comparing its own
    rows with all. Beyond that, pieces of bounded size are compared in pairs,
    most of which are ruled out by bounds, see ``balls``. Either way a task
    only puts out ``k`` rows per vector and piece.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    n = rows.count()
    width = rows.select(F.size("v").alias("n")).first()["n"]
    if n * (4 * width + 16) <= max_bytes:
        found = _knn_broadcast(rows, k)
    else:
        from sparsight.operators.balls import knn_balls

        return knn_balls(rows, k, "id", "v", block_rows)[0]
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _knn_broadcast(rows: DataFrame, k: int) -> DataFrame:
    table = rows.orderBy("id").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(
        (table["id"].to_numpy(), to_matrix(table["v"].combine_chunks(), np.float32))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others, y = shared.value
        y = y.astype(np.float64)
        step = max(1, _CELLS_PER_STEP // len(others))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = best_of(part.column("id").to_numpy(), to_matrix(part.column("v")), others, y, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in found], names=["id", "neighbour", "similarity"]
                )

    return rows.mapInArrow(run, _SCHEMA)
