"""Packing many documents into blocks of a fixed number of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparsight.operators.ordering import running_total
from sparsight.session import shuffle_partitions


def segment_batches(
    docs: DataFrame,
    budget: int,
    length: str = "n_tokens",
    key: str = "doc_id",
    splits: list[float] | None = None,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Which stretch [lo, hi) of which document falls in which token batch.

    Documents follow one another in key order and are cut exactly where a
    batch of ``budget`` tokens is full. A document yields one row per batch it
    touches, found by arithmetic on its offset, without a join.
    """
    placed = running_total(docs, key, F.col(length), "_off", splits, lengths).where(
        F.col(length) > 0
    )
    last = F.expr(f"(_off + {length} - 1) div {int(budget)}")
    first = F.expr(f"_off div {int(budget)}")
    spread = placed.withColumn("batch_id", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("batch_id") * budget - F.col("_off"), F.lit(0))
    hi = F.least((F.col("batch_id") + 1) * budget - F.col("_off"), F.col(length))
    return spread.withColumn("lo", lo.cast("int")).withColumn("hi", hi.cast("int")).drop("_off")


def pack(
    seqs: DataFrame,
    block: int,
    keep_tail: bool = False,
    key: str = "doc_id",
    splits: list[float] | None = None,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """(block_id, n_tokens, segments): blocks of ``block`` tokens each.

    A segment is (doc_id, start, ids), ``start`` being the true position of
    its first token in the document. A group collects ``block`` tokens and no
    more. The last, short block is left out unless ``keep_tail``.
    """
    pieces = segment_batches(
        seqs.withColumn("_n", F.size("seq")), block, "_n", key, splits, lengths
    ).select(
        F.col("batch_id").alias("block_id"),
        F.struct(
            F.col(key).alias("doc_id"),
            F.col("lo").alias("start"),
            F.slice("seq", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("ids"),
        ).alias("segment"),
    )
    # The exchange of the groupBy, but with a fixed number of partitions: blocks
    # are small next to the model run they feed, so tasks must not be merged.
    placed = pieces.repartition(shuffle_partitions(seqs.sparkSession), "block_id")
    blocks = placed.groupBy("block_id").agg(
        F.sum(F.size("segment.ids")).cast("int").alias("n_tokens"),
        F.sort_array(F.collect_list("segment")).alias("segments"),
    )
    return blocks if keep_tail else blocks.where(F.col("n_tokens") == block)


def unpack(blocks: DataFrame) -> DataFrame:
    """(block_id, doc_id, tok_pos, token_id): the token rows of the blocks."""
    return (
        blocks.select("block_id", F.explode("segments").alias("s"))
        .select("block_id", "s.doc_id", "s.start", F.posexplode("s.ids").alias("_j", "token_id"))
        .select(
            "block_id", "doc_id", (F.col("start") + F.col("_j")).alias("tok_pos"), "token_id"
        )
    )


def rebatch(
    vectors: DataFrame,
    size: int,
    key: str = "vec_id",
    vector: str = "activation",
    splits: list[float] | None = None,
) -> DataFrame:
    """``size`` consecutive vectors per row; a group holds ``size`` vectors."""
    placed = running_total(vectors, key, F.lit(1), "_idx", splits)
    rows = F.sort_array(F.collect_list(F.struct("_idx", vector)))
    return placed.groupBy(F.expr(f"_idx div {int(size)}").alias("batch_id")).agg(
        F.min(key).alias("first_key"),
        F.count("*").alias("n_rows"),
        F.transform(rows, lambda r: r[vector]).alias("activations"),
    )
