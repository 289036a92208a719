"""Joins that state how large the small side may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 64 << 20


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    row_bytes: int,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    salts: int = 32,
) -> DataFrame:
    """Attach a small ``right`` to a left side with hot keys.

    ``row_bytes`` bounds one row of ``right``. Where count x row_bytes fits,
    the right side is broadcast. Otherwise every right row is copied ``salts``
    times and the left rows spread over the copies by a hash of the whole row,
    so that no key of the left side stays in one task.
    """
    limit = max(1, max_bytes // row_bytes)
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    plain = [c for c, t in left.dtypes if not t.startswith(("map", "variant"))]
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    copies = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
