"""Statistics over activation rows.

Elements are exploded inside generated code and combined per task before any
exchange, so a hot group or dimension costs one partial row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Observation, functions as F

from sparsight.functions.vectors import from_matrix, squared_norm, to_matrix
from sparsight.operators.joins import lookup_join
from sparsight.session import materialize

_ROWS_AT_ONCE = 1_024
_BAND_CELLS = 1 << 17  # numbers of a sum that meet in one task
_MAX_WIDTH = 8192  # widest vector whose covariance the driver takes


def _x() -> Column:
    return F.col("x").cast("double")


def _elements(acts: DataFrame, *keep: str, column: str = "activation") -> DataFrame:
    return acts.select(*keep, F.posexplode(column).alias("dim", "x"))


def rms_stats(acts: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """tokens, rms = sqrt(mean squared vector norm), and rms per element.

    ``weight`` has the number of times that a vector stands for.
    """
    times = F.col(weight) if weight else F.lit(1).cast("long")
    total = F.sum(_x() * _x() * times)
    tokens = F.sum(F.when(F.col("dim") == 0, times).otherwise(F.lit(0).cast("long")))
    keep = [*by, weight] if weight else by
    return _elements(acts, *keep).groupBy(*by).agg(
        F.coalesce(tokens, F.lit(0).cast("long")).alias("tokens"),
        F.sqrt(total / tokens).alias("rms"),
        F.sqrt(total / F.sum(times)).alias("rms_elem"),
    )


def batch_norms(acts: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Mean squared vector norm per batch."""
    return _elements(acts, batch).groupBy(batch).agg(
        (F.sum(_x() * _x()) / F.count_if(F.col("dim") == 0)).alias("norm")
    )


def ema_norm(norms: DataFrame, decay: float = 0.9, batch: str = "batch_id") -> DataFrame:
    """Running norm after the last batch: new = decay * old + (1 - decay) * norm.

    Starts at 0. In closed form each batch counts by its distance from the
    last, so the batches may be summed in any order.
    """
    fixed = materialize(norms.select(batch, "norm"), "batch-norms")
    last = fixed.agg(F.max(batch)).first()[0]
    weight = (1.0 - decay) * F.pow(F.lit(decay), F.lit(last) - F.col(batch))
    return fixed.agg(
        F.count("*").alias("n_batches"), F.sum(weight * F.col("norm")).alias("ema")
    )


def element_stats(acts: DataFrame, *by: str) -> DataFrame:
    """Mean and population variance over all elements."""
    return _elements(acts, *by).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(_x()).alias("mean"), F.var_pop(_x()).alias("variance")
    )


def compare_layers(acts: DataFrame, layer: str = "layer") -> DataFrame:
    total = F.sum(_x() * _x())
    tokens = F.count_if(F.col("dim") == 0)
    return _elements(acts, layer).groupBy(layer).agg(
        tokens.alias("tokens"),
        F.avg(_x()).alias("mean"),
        F.var_pop(_x()).alias("variance"),
        F.min(_x()).alias("lo"),
        F.max(_x()).alias("hi"),
        F.sqrt(total / tokens).alias("rms"),
    )


def _with_bins(
    cells: DataFrame, lo: Column, hi: Column, bins: int
) -> DataFrame:
    width = (hi - lo) / bins
    bin_ = F.least(F.floor((_x() - lo) / width), F.lit(bins - 1)).cast("int")
    return cells.withColumn("bin", F.when(width > 0, bin_).otherwise(F.lit(0)))


def histogram(acts: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, lower, upper, n, density) over all elements, last bin closed."""
    lo, hi, total = (
        acts.where(F.col("activation").isNotNull()).agg(
            F.min(F.array_min("activation")).cast("double"),
            F.max(F.array_max("activation")).cast("double"),
            F.sum(F.size("activation")),
        ).first()
    )
    width = (hi - lo) / bins
    counted = _with_bins(_elements(acts), F.lit(lo), F.lit(hi), bins).groupBy("bin").agg(
        F.count("*").alias("n")
    )
    frame = acts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = frame.join(counted, "bin", "left").na.fill(0, ["n"])
    return filled.select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"),
        "n",
        (F.col("n") / (F.lit(total) * F.lit(width))).alias("density"),
    )


def histogram_by(acts: DataFrame, group: str, bins: int = 100) -> DataFrame:
    """The same per group, each group with its own range."""
    ranges = materialize(
        acts.groupBy(group).agg(
            F.min(F.array_min("activation")).cast("double").alias("_lo"),
            F.max(F.array_max("activation")).cast("double").alias("_hi"),
            F.sum(F.size("activation")).alias("_total"),
        ),
        "ranges",
    )
    cells = lookup_join(acts, ranges.drop("_total"), [group], row_bytes=64).select(
        group, "_lo", "_hi", F.explode("activation").alias("x")
    )
    counted = (
        _with_bins(cells, F.col("_lo"), F.col("_hi"), bins)
        .groupBy(group, "bin")
        .agg(F.count("*").alias("n"))
    )
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (
        frame.join(counted, [group, "bin"], "left")
        .na.fill(0, ["n"])
        .select(
            group, "bin",
            (F.col("_lo") + F.col("bin") * width).alias("lower"),
            "n",
            F.when(width > 0, F.col("n") / (F.col("_total") * width)).alias("density"),
        )
    )


def token_histogram(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token_id").agg(F.count("*").alias("n"))


def position_distribution(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("tok_pos").agg(F.count("*").alias("n"))


def dim_stats(acts: DataFrame, k: float = 3.0) -> DataFrame:
    """Per dimension: mean, variance, range, share beyond ``k`` deviations."""
    cells = _elements(acts)
    stats = cells.groupBy("dim").agg(
        F.count("*").alias("n"),
        F.avg(_x()).alias("mean"),
        F.var_pop(_x()).alias("variance"),
        F.min(_x()).alias("lo"),
        F.max(_x()).alias("hi"),
    )
    # one row per dimension: as many as a vector is wide
    flagged = cells.join(F.broadcast(stats), "dim")
    extreme = F.abs(_x() - F.col("mean")) > k * F.sqrt("variance")
    return (
        flagged.groupBy("dim", "n", "mean", "variance", "lo", "hi")
        .agg((F.count_if(extreme) / F.count("*")).alias("extreme_share"))
    )


def top_dims(stats: DataFrame, m: int, by: str = "variance") -> DataFrame:
    return stats.orderBy(F.desc(by), "dim").limit(m)


def dim_token_corr(acts: DataFrame, token: str = "token_id") -> DataFrame:
    """Correlation of every dimension with the presence of every token.

    Pearson's r against a 0/1 indicator needs only the sums inside the token
    and over everything; the latter follow from the former.
    """
    inside = materialize(  # one pass over the activations, two over their sums
        _elements(acts, token).groupBy(token, "dim").agg(
            F.count("*").alias("n_in"), F.sum(_x()).alias("s_in"), F.sum(_x() * _x()).alias("q_in")
        ),
        "token-sums",
    )
    whole = inside.groupBy("dim").agg(
        F.sum("n_in").alias("n"), F.sum("s_in").alias("s"), F.sum("q_in").alias("q")
    )
    n, s, q = F.col("n").cast("double"), F.col("s"), F.col("q")
    n_in, s_in = F.col("n_in").cast("double"), F.col("s_in")
    spread = F.sqrt(n * q - s * s) * F.sqrt(n * n_in - n_in * n_in)
    # whole: one row per dimension
    return inside.join(F.broadcast(whole), "dim").select(
        token, "dim", F.when(spread > 0, (n * s_in - s * n_in) / spread).alias("corr")
    )


def products(
    rows: DataFrame, column: str, bias: bool = False, shift: list[float] | None = None
) -> DataFrame:
    """(i, j, s): sums over all rows of x_i * x_j.

    Each task adds up one matrix; its rows then meet by ``i`` as whole vectors.
    With ``bias`` a constant 1 is appended to every vector: its cells are the
    column sums and, at the very end, the number of rows. ``shift`` is taken
    from every vector first.
    """

    def partial(batches):
        total = None
        for batch in batches:
            x = to_matrix(batch.column(0))
            if not len(x):
                continue
            if shift is not None:
                x = x - np.asarray(shift)
            if bias:
                x = np.hstack([x, np.ones((len(x), 1))])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), from_matrix(total, pa.float64())],
                names=["i", "row"],
            )

    def added(batches):
        sums: dict[int, np.ndarray] = {}  # the matrix rows of this task, as many as its share of the width
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), to_matrix(batch.column("row"))):
                sums[i] = sums[i] + row if i in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), from_matrix(np.stack(list(sums.values())), pa.float64())],
                names=["i", "row"],
            )

    schema = "i int, row array<double>"
    summed = rows.select(column).mapInArrow(partial, schema).repartition("i").mapInArrow(added, schema)
    return summed.select("i", F.posexplode("row").alias("j", "s"))


def _moments(acts: DataFrame, column: str) -> tuple[DataFrame, DataFrame, int, list[float]]:
    """Sums of products around one of the vectors, written; means around it; rows; that vector.

    Any vector of the table lies within its spread, so no digits are lost where
    the means are large next to it.
    """
    shift = [float(x) for x in acts.select(column).first()[0]]
    fixed = materialize(products(acts, column, bias=True, shift=shift), "products")
    last = len(shift)
    n = fixed.where((F.col("i") == last) & (F.col("j") == last)).first()["s"]
    means = fixed.where((F.col("i") == last) & (F.col("j") < last)).select(
        F.col("j").alias("d"), (F.col("s") / n).alias("m")
    )
    return fixed.where((F.col("i") < last) & (F.col("j") < last)), means, n, shift


def _covariance(sums: DataFrame, means: DataFrame, n: float) -> DataFrame:
    # means: one row per dimension
    mean_i = F.broadcast(means.select(F.col("d").alias("i"), F.col("m").alias("mi")))
    mean_j = F.broadcast(means.select(F.col("d").alias("j"), F.col("m").alias("mj")))
    return (
        sums.join(mean_i, "i").join(mean_j, "j")
        .select("i", "j", ((F.col("s") - n * F.col("mi") * F.col("mj")) / (n - 1)).alias("cov"))
    )


def covariance(acts: DataFrame, column: str = "activation") -> DataFrame:
    """(i, j, cov): sample covariance of the dimensions."""
    return _covariance(*_moments(acts, column)[:3])


@dataclass(frozen=True)
class Pca:
    mean: np.ndarray
    components: np.ndarray
    explained_ratio: np.ndarray


def pca_fit(acts: DataFrame, k: int = 2, column: str = "activation") -> Pca:
    """Principal directions; only the width x width matrix reaches the driver."""
    width = acts.select(F.size(column).alias("n")).first()["n"]
    if width > _MAX_WIDTH:
        raise ValueError(f"covariance of width {width} exceeds {_MAX_WIDTH}")
    sums, around, n, shift = _moments(acts, column)
    cells = _covariance(sums, around, n).toArrow()
    matrix = np.zeros((width, width))
    matrix[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["cov"].to_numpy()
    means = around.toArrow()
    mean = np.array(shift)
    mean[means["d"].to_numpy()] += means["m"].to_numpy()
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    components = vectors[:, order].T
    largest = np.abs(components).argmax(axis=1)
    components = components * np.sign(components[np.arange(k), largest])[:, None]
    return Pca(mean, components, values[order] / values.sum())


def _summed(acts: DataFrame, column: str, of, rows: int, width: int) -> np.ndarray:
    """The sum over all vectors of ``of(matrix of vectors)``, a matrix of ``rows`` x ``width``.

    Each task adds up its own; the sums meet on the executors in bands of rows.
    """
    band = max(1, _BAND_CELLS // width)

    def partial(batches):
        total = np.zeros((rows, width))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                total += of(to_matrix(batch.column(0).slice(at, _ROWS_AT_ONCE), np.float64))
        for at in range(0, rows, band):
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "g": [total[at : at + band].tobytes()]})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g) for g in group.column("g").to_pylist())
        return pa.table({"at": group.column("at")[:1], "g": pa.array([total.tobytes()], pa.binary())})

    kind = "at int, g binary"
    found = acts.select(column).mapInArrow(partial, kind).groupBy("at").applyInArrow(add, kind).toArrow()
    out = np.zeros((rows, width))
    for at, g in zip(found["at"].to_pylist(), found["g"].to_pylist()):
        piece = np.frombuffer(g).reshape(-1, width)
        out[at : at + len(piece)] = piece
    return out


def leading_axes(acts: DataFrame, column: str, k: int, rounds: int = 2, seed: int = 42) -> np.ndarray:
    """width x k (fewer where vectors are narrower): orthonormal axes that hold much of the squared length of the vectors.

    From random directions, each round multiplies by the second moments in one
    pass. For bounds any axes do, so the rounds are few and nothing is awaited.
    """
    width = acts.agg(F.max(F.size(column))).first()[0]
    axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(k, width))))[0]
    for _ in range(rounds):
        shared = axes
        image = _summed(acts, column, lambda x: x.T @ (x @ shared), width, shared.shape[1])
        if not np.isfinite(image).all():
            break
        axes = np.linalg.qr(image)[0]
    return axes


def pca_fit_wide(
    acts: DataFrame, k: int = 2, column: str = "activation", seed: int = 42, block: int | None = None,
    rounds: int = 60, tolerance: float = 1e-8,
) -> Pca:
    """Principal directions of vectors of any width, without their covariance matrix.

    From a random block of directions, every round multiplies by the covariance
    in one pass over the vectors; the best combination of all blocks so far is
    taken, until its residual is within ``tolerance`` of the largest variance.
    The driver holds ``width`` x ``block`` numbers per round. ``rounds`` bounds
    the passes; what they leave is an error, not a rougher answer.
    """
    first = acts.where(F.col(column).isNotNull()).select(column).first()
    n = acts.where(F.col(column).isNotNull()).count()
    if n < 2:
        raise ValueError("two vectors at least have a variance")
    rows = acts.where(F.col(column).isNotNull())
    width = len(first[0])
    shift = np.array(first[0], float)
    mean = shift + _summed(rows, column, lambda x: (x - shift).sum(axis=0)[:, None], width, 1)[:, 0] / n
    total = _summed(rows, column, lambda x: np.array([[((x - mean) ** 2).sum()]]), 1, 1)[0, 0] / (n - 1)
    size = min(width, block or max(k + 4, 8))
    fresh = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(rounds):
        shared = fresh
        image = _summed(rows, column, lambda x: (x - mean).T @ ((x - mean) @ shared), width, shared.shape[1]) / (n - 1)
        basis, images = np.hstack([basis, fresh]), np.hstack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(values)[::-1][:k]
        gap = images @ turn[:, best] - (basis @ turn[:, best]) * values[best]
        if len(best) == min(k, width) and np.linalg.norm(gap, axis=0).max() <= tolerance * max(total / width, values[best[0]]):
            break
        left = image - basis @ (basis.T @ image)
        left -= basis @ (basis.T @ left)
        q, triangle = np.linalg.qr(left)
        fresh = q[:, np.abs(np.diag(triangle)) > 1e-12 * max(total, 1e-300)]
        if not fresh.shape[1]:
            break
    else:
        raise ValueError(f"no convergence in {rounds} rounds: take a larger block")
    components = (basis @ turn[:, best]).T
    largest = np.abs(components).argmax(axis=1)
    components = components * np.sign(components[np.arange(len(best)), largest])[:, None]
    return Pca(mean, components, values[best] / total)


def pca_project(acts: DataFrame, model: Pca, column: str = "activation") -> DataFrame:
    """Coordinates along the principal directions."""
    mean, basis = model.mean, model.components.T

    @F.arrow_udf("array<double>")
    def project(array: pa.Array) -> pa.Array:
        return from_matrix((to_matrix(array) - mean) @ basis, pa.float64())

    return acts.withColumn("projection", project(column))


def cluster(acts: DataFrame, k: int, seed: int = 42, column: str = "activation") -> DataFrame:
    """Groups of similar vectors, with the distance to the own centroid."""
    vectors = acts.withColumn("_features", array_to_vector(column))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(vectors)
    centroids = acts.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cluster int, centroid array<double>",
    )
    gap = F.zip_with(column, "centroid", lambda x, c: x.cast("double") - c)
    # centroids: k rows
    return (
        model.transform(vectors)
        .join(F.broadcast(centroids), "cluster")
        .withColumn("distance", F.sqrt(squared_norm(gap)))
        .drop("_features", "centroid")
    )


def cluster_from(
    acts: DataFrame, starts: DataFrame, rounds: int, column: str = "activation"
) -> DataFrame:
    """``acts`` with ``cluster, distance`` after ``rounds`` moves of given centroids.

    ``starts`` has one row (cluster, centroid) per group. A round puts every
    vector to its nearest centroid, ties to the smaller number, and moves each
    centroid to the mean of its vectors; one that has none stays. A task adds
    up its vectors per cluster, so that a large cluster costs one row per task.
    """
    known = sorted((c, list(map(float, v))) for c, v in starts.select("cluster", "centroid").collect())
    names = np.array([c for c, _ in known], np.int32)
    centroids = np.array([v for _, v in known])

    def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        best = gaps.argmin(axis=1)
        return best, np.sqrt(gaps[np.arange(len(x)), best])

    def sums(centroids: np.ndarray):
        def run(batches):
            total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for batch in batches:
                x = to_matrix(batch.column(0))
                if len(x):
                    best = nearest(x, centroids)[0]
                    np.add.at(total, best, x)
                    n += np.bincount(best, minlength=len(n))
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array(n[at]), from_matrix(total[at], pa.float64())],
                    names=["at", "n", "total"],
                )

        return run

    for _ in range(rounds):
        parts = acts.select(column).mapInArrow(sums(centroids), "at int, n long, total array<double>")
        means = (
            parts.select("at", "n", F.posexplode("total").alias("dim", "s"))
            .groupBy("at", "dim").agg((F.sum("s") / F.sum("n")).alias("m")).toArrow()
        )  # one number per cluster and dimension
        centroids = centroids.copy()
        centroids[means["at"].to_numpy(), means["dim"].to_numpy()] = means["m"].to_numpy()

    @F.arrow_udf("struct<cluster int, distance double>")
    def placed(array: pa.Array) -> pa.Array:
        best, distance = nearest(to_matrix(array), centroids)
        return pa.StructArray.from_arrays([pa.array(names[best]), pa.array(distance)], ["cluster", "distance"])

    out = acts.withColumn("_placed", placed(column))
    return out.select(*acts.columns, "_placed.cluster", "_placed.distance")


def outliers(clustered: DataFrame, k: float = 3.0) -> DataFrame:
    """Rows further than ``k`` deviations from what is usual in their cluster."""
    clustered = materialize(clustered, "clustered")  # read for the usual distance and for the rows
    usual = clustered.groupBy("cluster").agg(
        F.avg("distance").alias("_mean"), F.stddev_pop("distance").alias("_sd")
    )
    # usual: one row per cluster
    return (
        clustered.join(F.broadcast(usual), "cluster")
        .where(F.col("distance") > F.col("_mean") + k * F.col("_sd"))
        .drop("_mean", "_sd")
    )


def batch_progress(acts: DataFrame, batch: str = "batch_id") -> DataFrame:
    return acts.groupBy(batch).agg(F.count("*").alias("n_rows"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as another action passes over them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen
