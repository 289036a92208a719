"""Positions in a total order without a window over the whole table.

Two levels: rows fall into key-range buckets, totals per bucket are few rows
and get a running sum, and the window that remains runs inside one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparsight.session import materialize, shuffle_partitions

_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def key_splits(df: DataFrame, key: str, buckets: int | None = None) -> list[float]:
    """Quantiles of a numeric key, so that buckets hold about as many rows each.

    Reads one column. Call it on the raw table where ``df`` is costly and hand
    the result to the operators below. At most ``buckets - 1`` numbers.
    """
    n = buckets or shuffle_partitions(df.sparkSession)
    if n < 2:
        return []
    cuts = df.select(F.col(key).cast("double").alias(key)).approxQuantile(
        key, [i / n for i in range(1, n)], 0.25 / n
    )
    return sorted(set(cuts))


def with_key_bucket(df: DataFrame, key: str, splits: list[float], out: str) -> DataFrame:
    """Number of the key range a row falls in: depends on its value alone."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    bucketizer = Bucketizer(
        splits=[float("-inf"), *splits, float("inf")], inputCol=key, outputCol=out
    )
    return bucketizer.transform(df).withColumn(out, F.col(out).cast("int"))


def _starts(totals: DataFrame, bucket: str, total: str, out: str) -> DataFrame:
    """Exclusive running sum over the bucket totals: one row per bucket."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        bucket, total, F.coalesce(F.sum(total).over(before), F.lit(0).cast("long")).alias(out)
    )


def running_total(
    df: DataFrame,
    key: str,
    value: Column,
    out: str,
    splits: list[float] | None = None,
    values: DataFrame | None = None,
) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``key`` (unique, numeric).

    ``df`` is read twice, once for the bucket totals. ``values``, a table of
    (key, value) that is cheaper to compute, may stand in for that pass; where
    its sums are not those of ``df``, the job fails instead of giving offsets
    that overlap or leave gaps.
    """
    cuts = key_splits(df, key) if splits is None else splits
    bucketed = with_key_bucket(df, key, cuts, "_bucket").withColumn("_value", value.cast("long"))
    counted = bucketed
    if values is not None:
        counted = with_key_bucket(values.toDF(key, "_value"), key, cuts, "_bucket")
    totals = counted.groupBy("_bucket").agg(F.sum("_value").cast("long").alias("_total"))
    starts = _starts(totals, "_bucket", "_total", "_start")
    inside = (
        Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = F.coalesce(F.sum("_value").over(inside), F.lit(0).cast("long"))
    place = F.col("_start") + local
    if values is not None:
        end = F.lead(F.lit(1)).over(Window.partitionBy("_bucket").orderBy(key)).isNull()
        wrong = end & (local + F.col("_value") != F.col("_total"))
        told = F.raise_error(F.lit(f"the given values do not add up to those of the rows, by {key}"))
        place = F.when(wrong, told.cast("long")).otherwise(place)
    # starts: one row per bucket, len(cuts) + 1 at most
    return (
        bucketed.join(F.broadcast(starts), "_bucket")
        .withColumn(out, place)
        .drop("_bucket", "_value", "_start", "_total")
    )


def index_documents(
    df: DataFrame, key: str = "doc_id", out: str = "doc_idx", splits: list[float] | None = None
) -> DataFrame:
    """Dense index 0..n-1 in key order."""
    return running_total(df, key, F.lit(1), out, splits)


def rank_rows(df: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """Dense rank in any order, composite or textual.

    Range partitions split even a run of equal leading values. The written
    copy pins each row's partition, so the two passes over it agree.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    fixed = materialize(ranged, "ranked").withColumn(
        "_part", F.shiftright("_mono", _PARTITION_BITS)
    )
    totals = fixed.groupBy("_part").agg(F.count("*").alias("_total"))
    starts = _starts(totals, "_part", "_total", "_start")
    within = F.col("_mono").bitwiseAND((1 << _PARTITION_BITS) - 1)
    # starts: one row per range partition
    return (
        fixed.join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + within + start)
        .drop("_part", "_mono", "_start", "_total")
    )


def shuffle(df: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """A repeatable global shuffle: sort by a hash of seed and key."""
    return df.orderBy(*shuffle_order(key, seed))


def shuffle_order(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


def shuffle_index(
    df: DataFrame, key: str = "doc_id", seed: int = 42, out: str = "shuffled_idx"
) -> DataFrame:
    """Position of each row in the shuffled order."""
    return rank_rows(df, shuffle_order(key, seed), out)


@dataclass(frozen=True)
class Permutation:
    """A keyed order of 0 .. n - 1 that gives each place by arithmetic, without a sort or a list.

    Cubes are a bijection modulo a prime that leaves 2 when divided by 3. The
    prime is the next such above ``n``; the few images of what lies between are
    left out of the count. Key and epoch choose the factor and the shifts.
    """

    n: int
    prime: int
    factor: int
    before: int
    after: int
    holes: tuple[int, ...]

    @staticmethod
    def of(n: int, seed: int, epoch: int = 0) -> Permutation:
        prime = n + 1
        while prime % 3 != 2 or not _is_prime(prime):
            prime += 1
        draw = hashlib.sha256(f"{seed}:{epoch}".encode()).digest()
        factor, before, after = (int.from_bytes(draw[i : i + 8]) % prime for i in (0, 8, 16))
        bare = Permutation(n, prime, factor or 1, before, after, ())
        return Permutation(n, prime, factor or 1, before, after, tuple(sorted(map(bare._image, range(n, prime)))))

    def _image(self, i: int) -> int:
        return (self.factor * pow(i + self.before, 3, self.prime) + self.after) % self.prime

    def place(self, i: int) -> int:
        image = self._image(i)
        return image - sum(h < image for h in self.holes)

    def at(self, place: int) -> int:
        """What stands at a place: the inverse of ``place``."""
        image = place
        for hole in self.holes:
            image += hole <= image
        cube = (image - self.after) * pow(self.factor, -1, self.prime)
        return (pow(cube, pow(3, -1, self.prime - 1), self.prime) - self.before) % self.prime

    def column(self, index: Column) -> Column:
        """``place`` of a column of whole numbers."""
        kind = "bigint" if self.prime < 1 << 31 else "decimal(38,0)"
        number = lambda x: F.lit(x).cast(kind)
        mod = lambda c: (c % number(self.prime)).cast(kind)
        x = mod(index.cast(kind) + number(self.before))
        image = mod(mod(mod(mod(x * x) * x) * number(self.factor)) + number(self.after)).cast("bigint")
        holes = F.array(*(F.lit(h).cast("bigint") for h in self.holes)).cast("array<bigint>")
        return image - F.size(F.filter(holes, lambda h: h < image))


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide every number below 2 ** 64."""
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n < 2 or any(n % p == 0 for p in small):
        return n in small
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in small:
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def epoch_order(
    df: DataFrame, n: int, epoch: int, index: str = "doc_idx", seed: int = 42, out: str = "epoch_idx"
) -> DataFrame:
    """The place of each row in the order of an epoch, from its dense index: a map, no shuffle."""
    return df.withColumn(out, Permutation.of(n, seed, epoch).column(F.col(index)))


def buffer_shuffle(
    df: DataFrame, key: str = "doc_id", size: int = 50_000, seed: int = 42, out: str = "shuffled_idx",
    splits: list[float] | None = None,
) -> DataFrame:
    """The rows of every key range in the order of a bounded buffer, with their ``range`` and their place in its order.

    A full buffer gives up a row at random for each that comes in; what is left
    leaves at random. So a row moves ahead by less than ``size`` places. Places
    count within a range, and the buffer is carried from batch to batch. The
    same table, seed and ``splits`` (numeric keys) give the same order. A task
    holds ``size`` rows.
    """
    cuts = key_splits(df, key) if splits is None else splits
    ranged = with_key_bucket(df, key, cuts, "range").repartition(len(cuts) + 1, "range").sortWithinPartitions("range", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, rng, place = None, None, None, 0

        def numbered(rows: pa.Table, order: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal place
            idx = pa.array(np.arange(place, place + len(order)))
            place += len(order)
            yield from rows.take(pa.array(order)).append_column(out, idx).combine_chunks().to_batches()

        for batch in batches:
            ranges = batch.column("range").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1), len(ranges)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if ranges[a] != number:
                    if held is not None and held.num_rows:
                        yield from numbered(held, rng.permutation(held.num_rows))
                    held, number, place = None, ranges[a], 0
                    rng = np.random.default_rng([seed, int(number)])
                rows = pa.Table.from_batches([batch.slice(a, b - a)])
                held = rows if held is None else pa.concat_tables([held, rows])
                if held.num_rows <= size:
                    continue
                slots, left = np.arange(size), np.empty(held.num_rows - size, np.int64)
                for i, slot in enumerate(rng.integers(0, size, len(left))):
                    left[i], slots[slot] = slots[slot], size + i
                yield from numbered(held, left)
                held = held.take(pa.array(slots))
        if held is not None and held.num_rows:
            yield from numbered(held, rng.permutation(held.num_rows))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    return ranged.mapInArrow(run, f"{kind}, `{out}` bigint")
