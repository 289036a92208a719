"""Exact k-means over blocks of vectors along a Hilbert curve, with the box of each block.

Vectors near to each other on the curve share a block. From the smallest and
largest value of every component in a block follow bounds on the distances of
all its vectors, so that most centroids need no look at them; those left are
compared exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsight.session import materialize

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
BLOCK = 64
CURVE_BITS = 4
#: components from here on would not leave a squared distance of 64 components in a long
LIMIT = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of ``cells`` on the Hilbert curve, as bytes that sort like it.

    ``cells`` is (rows, dimensions) of whole numbers below ``2**bits``. Each
    halving of the cube turns or mirrors what lies in its half, from the
    coarsest to the finest; the Gray code of what results is the place.
    """
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    for level in range(bits - 1, 0, -1):
        half, finer = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for axis in x:
            upper = (axis & half) != 0
            swap = np.where(upper, np.uint32(0), (x[0] ^ axis) & finer)
            x[0] ^= np.where(upper, finer, swap)
            axis ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = np.stack([x >> level & 1 for level in range(bits - 1, -1, -1)])
    raw = np.packbits(planes.transpose(2, 0, 1).reshape(x.shape[1], -1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in raw]


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int) -> DataFrame:
    """``vec_id, v``: the usable vectors with every component as floor(1024 x)."""
    usable = lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT // SCALE, F.lit(False))
    kept = vectors.where((F.size(embedding) == dimensions) & F.forall(embedding, usable))
    number = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return kept.select(F.col(vec_id).alias("vec_id"), number.alias("v"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _keyed(rows: DataFrame, dimensions: int) -> DataFrame:
    """``vec_id, v, place``: with the place on the curve. Its grid covers nine tenths of the vectors in full."""
    low, high = rows.agg(
        F.percentile_approx(F.array_min("v"), 0.05), F.percentile_approx(F.array_max("v"), 0.95)
    ).first()
    low, high = low or 0, high or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dimensions).astype(np.int64)
            cells = np.clip((v - low << CURVE_BITS) // (high - low + 1), 0, (1 << CURVE_BITS) - 1)
            keys = hilbert_keys(cells, CURVE_BITS) if len(v) else []
            raw = [row.tobytes() for row in v.astype("<i4")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "v", "place"]
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, v binary, place binary")


def blocks(keyed: DataFrame, dimensions: int = DIMENSIONS, size: int = BLOCK) -> DataFrame:
    """``ids, v, low, high, total``: up to ``size`` vectors of neighbouring places, their box, and their sum.

    A place that very many vectors share is cut by their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held else []), batch])
            full = held.num_rows - held.num_rows % size
            if full:
                yield from cut(held.slice(0, full))
                held = held.slice(full)
        if held and held.num_rows:
            yield from cut(held)

    def cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        v = np.frombuffer(b"".join(rows.column("v").to_pylist()), "<i4").reshape(-1, dimensions)
        ids = rows.column("vec_id").combine_chunks()
        starts = list(range(0, len(v), size))
        parts = [v[a : a + size] for a in starts]
        column = lambda f: pa.array([f(p).tobytes() for p in parts], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([*starts, len(v)], pa.int32()), ids), column(lambda p: p),
             column(lambda p: p.min(0)), column(lambda p: p.max(0)), column(lambda p: p.sum(0, dtype=np.int64))],
            ["ids", "v", "low", "high", "total"],
        )

    kind = keyed.schema["vec_id"].dataType.simpleString()
    order = ["place", F.xxhash64("vec_id", "v")]
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, f"ids array<{kind}>, v binary, low binary, high binary, total binary")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some vector of a box, by bounds on distances in it.

    First those nearer at best than another at worst; of these, those that no
    other beats all over the box: the difference of two squared distances is
    linear, so its largest value stands in a corner. A tie is the smaller's.
    """
    below, above = low - centroids, centroids - high
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    furthest = (np.maximum(abs(below), abs(above)) ** 2).sum(1)
    left = np.flatnonzero(nearest <= furthest.min())
    if len(left) < 2:
        return left
    c = centroids[left]
    apart = 2 * (c[None] - c[:, None])  # of the second from the first
    most = np.maximum(apart * low, apart * high).sum(2)
    square = (c**2).sum(1)
    worst = square[:, None] - square[None] + most
    beaten = (worst < 0) | ((worst == 0) & (np.arange(len(left))[:, None] < np.arange(len(left))))
    return left[~beaten.any(0)]


def nearest(v: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids ``among`` for each vector, and its squared distance."""
    distance = np.stack([((v - centroids[c]) ** 2).sum(1) for c in among])
    best = distance.argmin(0)
    return among[best], distance[best, np.arange(len(v))]


def _numbers(raw: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(raw, kind).astype(np.int64)


def _sums(table: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums of components by (cluster, component), and counts as component -1. One set of partial sums per task."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                among = candidates(_numbers(row["low"]), _numbers(row["high"]), centroids)
                if len(among) == 1:
                    total[among[0]] += _numbers(row["total"], "<i8")
                    count[among[0]] += row["n"]
                    continue
                v = _numbers(row["v"]).reshape(-1, dimensions)
                cluster, _ = nearest(v, centroids, among)
                for c in np.unique(cluster):
                    total[c] += v[cluster == c].sum(0)
                    count[c] += (cluster == c).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(count), dtype=np.int32)), pa.array(np.column_stack([count, total]).tolist(), pa.list_(pa.int64()))],
            ["cluster", "parts"],
        )

    rows = table.select("v", "low", "high", "total", F.size("ids").alias("n")).mapInArrow(run, "cluster int, parts array<bigint>")
    # at most clusters x (dimensions + 1) numbers
    parts = rows.select("cluster", F.posexplode("parts").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x"))
    return {(c, place - 1): x for c, place, x in parts.collect()}


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the vectors nearest to each centroid; one without any stays."""
    sums = _sums(table, centroids)
    out = centroids.copy()
    for c in range(len(out)):
        n = sums.get((c, -1), 0)
        if n:
            out[c] = [sums[c, i] // n for i in range(out.shape[1])]
    return out


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, v = (batch.column(c).to_pylist() for c in ("low", "high", "v"))
            found = [
                nearest(_numbers(x).reshape(-1, dimensions), centroids, candidates(_numbers(a), _numbers(b), centroids))
                for x, a, b in zip(v, low, high)
            ]
            cluster, distance = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids").flatten(), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"],
            )

    kind = table.schema["ids"].dataType.elementType.simpleString()
    return table.select("ids", "v", "low", "high").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def starts(keyed: DataFrame, clusters: int, dimensions: int, seed: int = 3) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``, in its order; null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = keyed.orderBy(order.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.stack([_numbers(r.v) for r in first]) if first else np.zeros((0, dimensions), np.int64)


def clusters(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, cluster_inertia, inertia`` of every usable vector, and the final centroids.

    Usable are vectors of ``dimensions`` finite components, each below 131,072
    in magnitude: beyond, squared distances leave a long. Others, null ones
    too, take no part. Of equal distances the smaller number wins. With fewer
    than ``k`` vectors each is a centroid; without any, the table is empty.
    Repeated rows stay repeated; other columns take no part.
    """
    keyed = materialize(_keyed(whole_numbers(vectors, vec_id, embedding, dimensions), dimensions), "keyed")
    table = materialize(blocks(keyed, dimensions), "blocks")
    centroids = starts(keyed, k, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(table, centroids)
    found = materialize(assigned(table, centroids), "assigned")
    by = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # one row per cluster
    own = F.array(*(F.lit(by.get(c, 0)).cast("bigint") for c in range(len(centroids)))).cast("array<bigint>")
    out = found.withColumn("cluster_inertia", F.get(own, F.col("cluster")))
    return out.withColumn("inertia", F.lit(sum(by.values())).cast("bigint")), centroids
