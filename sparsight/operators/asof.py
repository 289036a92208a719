"""The latest saved row before each row, by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sparsight.operators.ordering import key_splits, with_key_bucket


def as_of(
    rows: DataFrame, saved: DataFrame, by: Sequence[str], time: str, saved_time: str, splits: list[float] | None = None,
) -> DataFrame:
    """``rows`` with the other columns of the last ``saved`` row of the same ``by`` at or before their ``time``.

    Times are whole numbers, timestamps or doubles. Time is cut into ranges
    that hold about as many rows each; a range of one ``by`` is one window, and
    what came before it is one carried row, so a ``by`` with very many rows
    spreads over tasks. Of saved rows with one time, the largest by its columns
    counts. Rows without a match, or with a null in ``by`` or ``time``, stay
    with nulls; repeated rows stay repeated.
    """
    by = list(by)
    values = [c for c in saved.columns if c not in by]
    kept = F.struct(*(F.col(c) for c in (saved_time, *(v for v in values if v != saved_time)))).alias("_saved")
    usable = saved.where(F.col(saved_time).isNotNull()).select(*by, F.col(saved_time).cast("double").alias("_time"), kept)
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row")
    asked = rows.select(*by, F.col(time).cast("double").alias("_time"), whole)
    events = usable.unionByName(asked, allowMissingColumns=True)
    cuts = key_splits(asked.where(F.col("_time").isNotNull()), "_time") if splits is None else splits
    # a null time has a range of its own, so that no window orders by it
    events = with_key_bucket(events, "_time", cuts, "_range").withColumn("_range", F.coalesce("_range", F.lit(-1)))
    inside = Window.partitionBy(*by, "_range").orderBy("_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = events.where(F.col("_saved").isNotNull()).groupBy(*by, "_range").agg(F.max("_saved").alias("_last"))
    # one row per range and key that has saved rows or rows that ask
    seen = events.select(*by, "_range").distinct().join(ends, [*by, "_range"], "left")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select(*by, "_range", "_carry")
    near = events.withColumn("_near", F.max("_saved").over(inside)).where(F.col("_row").isNotNull())
    found = near.join(carried, [*by, "_range"], "left")
    match = F.when(F.col("_time").isNotNull(), F.coalesce("_near", "_carry"))
    for c in by:
        match = F.when(F.col(c).isNotNull(), match)
    return found.withColumn("_match", match).select("_row.*", *(F.col(f"_match.`{v}`").alias(v) for v in values))
