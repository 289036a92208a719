"""Exact nearest vectors by inner product, with most pairs ruled out by balls.

Every vector joins the ball of its nearest pivot; a ball is cut into pieces of
bounded size by ascending id. Two vectors that lie within ``r`` of ``b`` have an
inner product with ``x`` of at most ``x b + |x| r``. A first round compares each
piece with itself and a few near ones, which gives every vector a k-th best; a
second round compares it only with pieces that could hold a better one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparsight.functions.vectors import to_matrix
from sparsight.operators.neighbours import best_of
from sparsight.operators.ordering import rank_rows
from sparsight.session import materialize

PIECE_BYTES = 2 << 20
PIVOT_BYTES = 16 << 20
MAX_PIVOTS = 4_096
MAX_PIECES = 1 << 20  # of each, some forty bytes are broadcast
_FEW = 8  # pieces that meet one in a task
_CELLS = 1 << 22
_SHIFT = 32

_FOUND = "id bigint, neighbour bigint, similarity double"


def _numbers(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, v, ball, away``: the nearest pivot and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = shared.value
        square = (p * p).sum(axis=1)
        step = max(1, _CELLS // len(p))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = to_matrix(part.column("v"), np.float64)
                ball = (square - 2 * (x @ p.T)).argmin(axis=1)
                away = np.sqrt(((x - p[ball]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(ball.astype(np.int32)), pa.array(away)],
                    ["id", "v", "ball", "away"],
                )

    return rows.mapInArrow(run, "id bigint, v binary, ball int, away double")


def _pieces(assigned: DataFrame, rows_each: int) -> DataFrame:
    """``piece, ball, low, radius, ids, v``: the pieces of every ball in the order of ids."""
    ranked = rank_rows(assigned, [F.asc("ball"), F.asc("id")], "at")
    starts = ranked.groupBy("ball").agg(F.min("at").alias("start"))  # one row per pivot
    piece = F.shiftleft(F.col("ball").cast("bigint"), _SHIFT) + F.floor((F.col("at") - F.col("start")) / rows_each)
    placed = ranked.join(F.broadcast(starts), "ball").select(piece.alias("piece"), "ball", "id", "away", "v")

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids = rows.column("id").to_pylist()
        away = rows.column("away").to_numpy()
        return pa.table({
            "piece": rows.column("piece")[:1], "ball": rows.column("ball")[:1], "low": pa.array(ids[:1], pa.int64()),
            "radius": pa.array([away.max()]), "ids": pa.array([ids], pa.list_(pa.int64())),
            "v": pa.array([b"".join(rows.column("v").to_pylist())], pa.binary()),
        })

    kind = "piece bigint, ball int, low bigint, radius double, ids array<bigint>, v binary"
    return placed.groupBy("piece").applyInArrow(gather, kind)


def _could_hold(x: np.ndarray, pivot: np.ndarray, radius: np.ndarray, low: np.ndarray, floor: np.ndarray, floor_id: np.ndarray) -> np.ndarray:
    """Whether vectors (rows) may find a better one in pieces (columns) than their k-th best.

    A piece of radius zero holds its pivot only, so its bound is met exactly,
    and ties are told apart by ids.
    """
    norm = np.sqrt((x * x).sum(axis=1))
    bound = np.round(x @ pivot.T, 9) + norm[:, None] * radius * (1 + 1e-9) + np.where(radius > 0, 2e-9, 0.0)
    return (bound > floor[:, None]) | ((bound == floor[:, None]) & (low < floor_id[:, None]))


def _merged(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, others, similarity = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((others, -similarity, ids))
    ids, others, similarity = ids[order], others[order], similarity[order]
    kept = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
    return ids[kept], others[kept], similarity[kept]


def _stepped(ids, x, others, y, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step = max(1, _CELLS // max(1, len(others)))
    parts = [best_of(ids[at : at + step], x[at : at + step], others, y, k) for at in range(0, len(ids), step)]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def knn_balls(
    vectors: DataFrame, k: int, key: str = "vec_id", column: str = "activation", piece_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``id, neighbour, similarity, rank`` as ``knn`` gives them, and the pairs of pieces compared (``q, c, round``).

    Exact for any vectors of one width; how many pairs are ruled out depends on
    how far they cluster. Pivots are a bounded sample of the vectors. Null
    vectors take no part; ids are unique. An empty table gives empty results.
    """
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(column).alias("v"))
    spark = rows.sparkSession
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], f"{_FOUND}, rank int"), spark.createDataFrame([], "q bigint, c bigint, round int")
    each = max(piece_rows or max(64, PIECE_BYTES // (8 * width)), -(-n // MAX_PIECES))
    pivots_n = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * width), -(-n // each)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(pivots_n).toArrow()
    pivots = np.unique(to_matrix(drawn["v"].combine_chunks(), np.float64), axis=0)
    pieces = materialize(_pieces(materialize(_assigned(rows, pivots), "assigned"), each), "pieces")
    summary = pieces.select("piece", "ball", "low", "radius").orderBy("piece").toArrow()
    told = {c: summary[c].to_numpy() for c in summary.column_names}
    shared = spark.sparkContext.broadcast((pivots, told))

    # first round: itself, the first and the next piece of its ball, and the first pieces of the two balls most alike
    firsts = np.unique(told["ball"], return_index=True)[1]
    alike = pivots[told["ball"][firsts]] @ pivots[told["ball"][firsts]].T
    near = np.argsort(-alike, axis=1, kind="stable")[:, :3]
    of_ball = {int(told["ball"][f]): told["piece"][firsts[m]] for f, m in zip(firsts, near)}
    here = {int(told["ball"][f]): int(told["piece"][f]) for f in firsts}
    known = set(told["piece"].tolist())
    start = [
        (p, c) for p, b in zip(told["piece"].tolist(), told["ball"].tolist())
        for c in {p, here[b], *of_ball[b].tolist(), *({p + 1} & known)}
    ]
    first_pairs = spark.createDataFrame(pa.table({"q": [q for q, _ in start], "c": [c for _, c in start]}))
    mine = pieces.select(F.col("piece").alias("q"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    theirs = pieces.select(F.col("piece").alias("c"), "ids", "v", "ball", "radius", "low")

    def first(q: pa.Table, c: pa.Table) -> pa.Table:
        p, every = shared.value
        me = q.to_pylist()[0]
        ids, x = np.array(me["q_ids"]), _numbers(me["q_v"], width)
        found = [_stepped(ids, x, np.array(r["ids"]), _numbers(r["v"], width), k) for r in c.to_pylist()]
        ids_, others, similarity = _merged(found, k)
        end = np.searchsorted(ids_, ids, "right")
        full = end - np.searchsorted(ids_, ids) == k
        last = np.maximum(end - 1, 0)
        at = lambda a, empty: np.where(full, a[last] if len(a) else empty, empty)
        floor, floor_id = at(similarity, -np.inf), at(others, np.iinfo(np.int64).max)
        seen = set(c.column("c").to_pylist())
        left = np.zeros(len(every["piece"]), bool)
        step = max(1, _CELLS // len(ids))
        for a in range(0, len(left), step):
            part = slice(a, a + step)
            left[part] = _could_hold(x, p[every["ball"][part]], every["radius"][part], every["low"][part], floor, floor_id).any(axis=0)
        still = [c for c in every["piece"][left].tolist() if c not in seen]
        return pa.table({
            "q": pa.array([me["q"]], pa.int64()), "open": pa.array([still], pa.list_(pa.int64())),
            "floor": pa.array([floor.tolist()], pa.list_(pa.float64())), "floor_id": pa.array([floor_id.tolist()], pa.list_(pa.int64())),
            "found": pa.array([[{"id": i, "neighbour": o, "similarity": s} for i, o, s in zip(ids_.tolist(), others.tolist(), similarity.tolist())]],
                              pa.list_(pa.struct([("id", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64())]))),
        })

    kind = "q bigint, open array<bigint>, floor array<double>, floor_id array<bigint>, found array<struct<id:bigint,neighbour:bigint,similarity:double>>"
    lists = materialize(
        mine.groupBy("q").cogroup(first_pairs.join(theirs, "c").groupBy("q")).applyInArrow(first, kind), "first"
    )
    opened = lists.select(F.col("q").alias("q"), F.posexplode("open").alias("place", "c")).withColumn("part", F.floor(F.col("place") / _FEW).cast("int"))
    groups = lists.where(F.size("open") > 0).select(
        F.col("q").alias("q"), "floor", "floor_id", F.explode(F.sequence(F.lit(0), F.floor((F.size("open") - 1) / _FEW).cast("int"))).alias("part")
    ).join(mine, "q")

    def second(q: pa.Table, c: pa.Table) -> pa.Table:
        p, _ = shared.value
        me = q.to_pylist()[0]
        ids, x = np.array(me["q_ids"]), _numbers(me["q_v"], width)
        floor, floor_id = np.array(me["floor"]), np.array(me["floor_id"])
        found = []
        for r in c.to_pylist():
            one = lambda a: np.array([a])
            may = _could_hold(x, p[[r["ball"]]], one(r["radius"]), one(r["low"]), floor, floor_id)[:, 0]
            found.append(_stepped(ids[may], x[may], np.array(r["ids"]), _numbers(r["v"], width), k) if may.any() else None)
        found = [f for f in found if f]
        ids, others, similarity = _merged(found, k) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"id": ids, "neighbour": others, "similarity": similarity})

    more = groups.groupBy("q", "part").cogroup(opened.join(theirs, "c").groupBy("q", "part")).applyInArrow(second, _FOUND)
    every = lists.select(F.explode("found").alias("f")).select("f.*").unionByName(more)
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    ranked = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    visits = first_pairs.withColumn("round", F.lit(1)).unionByName(opened.select("q", "c", F.lit(2).alias("round")))
    return ranked, visits
