"""Nearest vectors by stable projections in a kd-tree, with a chi-square stopping test.

Vectors are lifted by one component so that the largest inner product is the
smallest distance, and projected by a Gaussian matrix to a few dimensions. The
top of a kd-tree over the projections, built from a bounded sample, deals the
vectors into cells; each cell holds the rest of the tree. A query looks at
leaves in the order of their projected distance and verifies their vectors in
full. Of a vector at distance d, the squared projected distance over d squared
is chi-squared; a query stops where that makes a nearer unseen vector unlikely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from sparsight.session import materialize

K, DIMENSIONS, CONFIDENCE = 20, 8, 0.97
#: vectors that shape the top of the tree; vectors of a cell on average; vectors of a leaf
SAMPLE, CELL, LEAF = 20_000, 4096, 64
MAX_CELLS = 1 << 14
_SEED = 11


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """The chi-squared distribution function for an even number ``m`` of degrees of freedom."""
    half = np.minimum(np.asarray(x, float), 1e4) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def stop_ratio(confidence: float, m: int) -> float:
    """Where the distribution function reaches ``confidence``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < confidence else (low, mid)
    return high


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), width)


class Tree:
    """Leaves of a kd-tree over given points: their order, ends and bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order, ends = np.arange(len(points)), []

        def split(a: int, b: int) -> None:
            if b - a <= leaf:
                ends.append(b)
                return
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            split(a, a + mid)
            split(a + mid, b)

        if len(points):
            split(0, len(points))
        self.ends = np.array([0, *ends])
        at = self.ends[:-1]
        moved = points[self.order]
        self.low = np.minimum.reduceat(moved, at) if len(points) else moved
        self.high = np.maximum.reduceat(moved, at) if len(points) else moved


def box_distance(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    out = np.zeros((len(queries), len(low)))
    for j in range(queries.shape[1]):
        q = queries[:, j : j + 1]
        gap = np.maximum(np.maximum(low[:, j] - q, q - high[:, j]), 0)
        out += gap * gap
    return out


def cuts(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """The inner nodes of a balanced tree with ``cells`` (a power of two) cells, as axis and value, from the top."""
    nodes: list[tuple[int, float]] = []
    level = [points]
    while len(level) < cells:
        nxt = []
        for own in level:
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            value = float(np.median(own[:, axis])) if len(own) else 0.0
            nodes.append((axis, value))
            nxt += [own[own[:, axis] < value], own[own[:, axis] >= value]]
        level = nxt
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each point."""
    axis = np.array([n[0] for n in nodes], np.int64)
    value = np.array([n[1] for n in nodes])
    at = np.zeros(len(points), np.int64)
    while len(nodes) and at.size and at.min() < len(nodes):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] >= value[at])
    return at - len(nodes)


def search(
    queries: np.ndarray, projected: np.ndarray, bound: np.ndarray, vectors: np.ndarray, points: np.ndarray,
    ids: np.ndarray, k: int, ratio: float, lift: float, leaf: int = LEAF,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, id, score`` of up to ``k`` nearest found in one cell for each query.

    ``bound`` is the k-th best score that a query has from elsewhere. Leaves
    are taken in the order of their projected distance; a query ends where the
    next leaf's squared distance is over ``ratio`` times the squared distance
    of its k-th best.
    """
    tree = Tree(points, leaf)
    best = np.full((len(queries), k), -np.inf)
    names = np.full((len(queries), k), np.iinfo(np.int64).max)
    norm = (queries * queries).sum(axis=1)
    step = 1 + (1 << 20) // max(1, len(tree.low))
    for a in range(0, len(queries), step):
        distance = box_distance(projected[a : a + step], tree.low, tree.high)
        order = np.argsort(distance, axis=1)
        alive = np.arange(len(distance))
        for r in range(distance.shape[1]):
            kth = np.maximum(best[a + alive, k - 1], bound[a + alive])
            reach = ratio * (norm[a + alive] + lift - 2 * kth)
            alive = alive[distance[alive, order[alive, r]] <= np.where(np.isfinite(kth), reach, np.inf)]
            if not len(alive):
                break
            for leaf_number in np.unique(order[alive, r]):
                rows = alive[order[alive, r] == leaf_number] + a
                own = tree.order[tree.ends[leaf_number] : tree.ends[leaf_number + 1]]
                score = np.einsum("qd,vd->qv", queries[rows], vectors[own])
                both = np.concatenate([best[rows], score], axis=1)
                name = np.concatenate([names[rows], np.broadcast_to(ids[own], score.shape)], axis=1)
                first = np.lexsort((name, -both), axis=1)[:, :k]
                best[rows] = np.take_along_axis(both, first, axis=1)
                names[rows] = np.take_along_axis(name, first, axis=1)
    query, place = np.nonzero(np.isfinite(best))
    return query, names[query, place], best[query, place]


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, vec_id: str = "vec_id", embedding: str = "embedding",
    k: int = K, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, every: int = 20,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors found with the largest inner product.

    Queries are the rows of ``queries``, by default those whose id is divisible
    by ``every``. Vectors take no part that are null, zero, without an id, of
    another length than most, or hold a null or non-finite component. Equal
    vectors are searched once: of one vector only its ``k + 1`` smallest ids
    can be in a result, and only these stand in the index. A query is never its
    own neighbour; repeated rows of one id and vector count once. Ties go to
    the smaller id.
    """
    if dimensions % 2:
        raise ValueError("an even number of dimensions has the closed form that the stopping test uses")
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        e = F.col("e")
        finite = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return (
            df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
            .where(F.col("id").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("e", lambda x: x != 0))
        )

    rows = usable(vectors)
    common = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return spark.createDataFrame([], empty)
    width = common["n"]
    rows = rows.where(F.size("e") == width).withColumn("key", F.xxhash64("e"))
    asked = rows.where(F.col("id") % every == 0) if queries is None else usable(queries).where(
        F.size("e") == width
    ).withColumn("key", F.xxhash64("e"))

    # the k + 1 smallest ids of each vector
    first = Window.partitionBy("e").orderBy("id")
    kept = rows.dropDuplicates(["id", "e"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    kept = materialize(kept.select("id", "e", "key"), "vectors")
    top, total = kept.agg(F.max(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)), F.count("*")).first()
    if top is None:
        return spark.createDataFrame([], empty)
    rng = np.random.default_rng(_SEED)
    frame = rng.standard_normal((width + 1, dimensions))
    cells = 1
    while cells * CELL < total and cells < MAX_CELLS:
        cells *= 2
    sample = kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("e") if total > SAMPLE else kept.select("e")
    drawn = matrix(pa.array([r.e for r in sample.collect()], pa.list_(pa.float64())), width)

    def project(x: np.ndarray, lifted: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0)) if lifted else np.zeros(len(x))
        return x @ frame[:-1] + extra[:, None] * frame[-1]

    nodes = cuts(project(drawn, True), cells)
    ratio = stop_ratio(confidence, dimensions)

    def deal(lifted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = project(matrix(batch.column("e"), width), lifted)
                extra = [pa.array(cell_of(points, nodes)), pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), dimensions).cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "cell", "p"])

        return run

    index = materialize(
        kept.mapInArrow(deal(True), "id bigint, e array<double>, key bigint, cell bigint, p array<double>"), "index"
    )
    boxes = index.groupBy("cell").agg(
        *(F.min(F.col("p")[j]).alias(f"l{j}") for j in range(dimensions)),
        *(F.max(F.col("p")[j]).alias(f"h{j}") for j in range(dimensions)), F.count("*").alias("n"),
    ).orderBy("cell").collect()  # at most MAX_CELLS rows
    numbers = np.array([b.cell for b in boxes])
    low = np.array([b[1 : 1 + dimensions] for b in boxes], float).reshape(-1, dimensions)
    high = np.array([b[1 + dimensions : 1 + 2 * dimensions] for b in boxes], float).reshape(-1, dimensions)
    distinct = asked.groupBy("key", "e").agg(F.min("id").alias("least"))
    ask = materialize(distinct.select("key", "e").mapInArrow(
        deal(False), "key bigint, e array<double>, cell bigint, p array<double>"
    ), "queries")

    def visits(first_round: bool):
        """The cells that a query goes to: its nearest, or those that its k-th best leaves open."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                distance = box_distance(matrix(batch.column("p"), dimensions), low, high)
                home = distance.argmin(axis=1)
                if first_round:
                    query, cell = np.arange(len(home)), home
                    bound = np.full(len(home), -np.inf)
                else:
                    e = matrix(batch.column("e"), width)
                    bound = batch.column("bound").to_numpy(zero_copy_only=False)
                    reach = ratio * ((e * e).sum(axis=1) + top - 2 * bound)
                    open_ = distance <= np.where(np.isfinite(bound), reach, np.inf)[:, None]
                    open_[np.arange(len(home)), home] = False
                    query, cell = np.nonzero(open_)
                taken = batch.select(["key", "e", "p"]).take(pa.array(query))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(numbers[cell]), pa.array(bound[query] if not first_round else bound)],
                    ["key", "e", "p", "cell", "bound"],
                )

        return run

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            one = lambda t, c: t.column(c).combine_chunks()
            query, name, score = search(
                matrix(one(left, "e"), width), matrix(one(left, "p"), dimensions), one(left, "bound").to_numpy(zero_copy_only=False),
                matrix(one(right, "e"), width), matrix(one(right, "p"), dimensions), one(right, "id").to_numpy(),
                k + 1, ratio, top,
            )
            key = one(left, "key").take(pa.array(query))
        else:
            key, name, score = pa.array([], pa.int64()), np.empty(0, np.int64), np.empty(0)
        return pa.table({"key": key, "vec_id": pa.array(name), "score": pa.array(score)})

    # a cell with many queries is met by blocks of them, each with a copy of the cell's vectors
    def meet(asking: DataFrame) -> DataFrame:
        asking = materialize(asking, "visits")
        count = asking.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
        dealt = asking.join(count, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("bigint")))
        copies = index.select("id", "e", "p", "cell").join(count, "cell").withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1))
        )
        return dealt.drop("blocks").groupBy("cell", "block").cogroup(
            copies.drop("blocks").groupBy("cell", "block")
        ).applyInArrow(look, "key bigint, vec_id bigint, score double")

    shape = "key bigint, e array<double>, p array<double>, cell bigint, bound double"
    found = materialize(meet(ask.mapInArrow(visits(True), shape)), "found")
    # enough results at home give the k-th best, else every cell stays open
    kth = found.groupBy("key").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(
        "key", F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("bound")
    )
    wider = ask.join(kth, "key", "left").na.fill(float("-inf"), ["bound"])
    found = found.unionByName(meet(wider.mapInArrow(visits(False), shape)))
    ranked = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    lists = found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)
    lists = lists.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    ids = asked.select(F.col("id").alias("query_id"), "key").distinct()
    return ids.join(materialize(lists, "lists"), "key").select(
        "query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "x")
    ).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
