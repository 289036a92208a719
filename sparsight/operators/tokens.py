"""Tokens: vocabulary, ids, positions, padding, chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sparsight.functions import text as tx
from sparsight.operators.ordering import index_documents, rank_rows
from sparsight.session import materialize, small_batches

BOS_ID = 0
EOS_ID = 1
FIRST_WORD_ID = 2

# A vocabulary up to this many words and bytes is broadcast whole; beyond them only
# its most frequent HEAD_WORDS are, and the rest meets its tokens in a shuffle.
BROADCAST_WORDS = 500_000
BROADCAST_BYTES = 64 << 20
HEAD_WORDS = 500_000
HEAD_WORD_BYTES = 128  # longer words are coded in place only among the first of these

_POS_BITS = 32


def build_vocab(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, token_id): ids by count descending, then token ascending."""
    counts = (
        df.select(F.explode(tx.words(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    ranked = rank_rows(counts, [F.desc("n"), F.asc("token")], "token_id", FIRST_WORD_ID)
    return ranked.withColumn("token_id", F.col("token_id").cast("int"))


def _small(vocab: DataFrame, words: int) -> bool:
    """Whether a vocabulary may be broadcast whole: its words are counted and measured."""
    n, size = vocab.agg(F.count("*"), F.sum(F.octet_length("token"))).first()
    return n <= words and (size or 0) <= BROADCAST_BYTES


def _coder(vocab: DataFrame, rest: bool):
    """Words to ids by a broadcast vocabulary: no exchange, and no row per word.

    What has no id is left out. With ``rest`` it is -1 instead, and the words
    that are come along, in order.
    """
    table = vocab.toArrow()
    columns = [table.column(c).combine_chunks() for c in ("token", "token_id")]
    shared = vocab.sparkSession.sparkContext.broadcast(columns)

    def parts(words: pa.Array) -> tuple:
        known, numbers = shared.value
        coded = words.flatten().dictionary_encode()
        # each distinct word is looked up once
        of_word = numbers.take(pc.index_in(coded.dictionary.cast(known.type), value_set=known))
        found = of_word.take(coded.indices).cast(pa.int32())
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        return coded, found, np.concatenate([[0], np.cumsum(sizes)])

    def cut(ends: np.ndarray, kept: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(kept)])[ends], pa.int32())

    @F.arrow_udf("array<int>")
    def ids(words: pa.Array) -> pa.Array:
        _, found, ends = parts(words)
        return pa.ListArray.from_arrays(cut(ends, found.is_valid().to_numpy(zero_copy_only=False)), found.drop_null())

    @F.arrow_udf("struct<ids:array<int>,rest:array<string>>")
    def ids_and_rest(words: pa.Array) -> pa.Array:
        coded, found, ends = parts(words)
        unknown = found.is_null()
        left = coded.filter(unknown)
        left = left.dictionary.take(left.indices).cast(pa.string())
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.fill_null(-1)),
                pa.ListArray.from_arrays(cut(ends, unknown.to_numpy(zero_copy_only=False)), left),
            ],
            ["ids", "rest"],
        )

    # no filter on the sizes of sequences may be pushed below it, or every text would be coded twice
    return (ids_and_rest if rest else ids).asNondeterministic()


@F.arrow_udf(ArrayType(IntegerType()))
def _filled(ids: pa.Array, found: pa.Array) -> pa.Array:
    """``ids`` with what was found, in order, in place of each -1; what still is -1 is left out."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).copy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
    flat[flat == -1] = found.flatten().to_numpy(zero_copy_only=False)
    kept = flat != -1
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(kept)])[ends], pa.int32()), pa.array(flat[kept], pa.int32())
    )


def tokenize(
    df: DataFrame,
    vocab: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    broadcast_words: int = BROADCAST_WORDS,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """(key, ids): the word ids of each document in order, no special tokens.

    Words outside the vocabulary have no id and are left out. With a small
    vocabulary documents stay where they are. Beyond that the most frequent
    words are coded where they stand, and only the others become rows to meet
    the vocabulary; a group is those of one document, which already was one row.
    """
    vocab = vocab.select("token", "token_id")
    if _small(vocab, broadcast_words):
        return df.select(key, _coder(vocab, False)(tx.words(F.col(text))).alias("ids"))
    # Ids follow frequency: the head holds every hot word, so no word of the tail is
    # a large share of all tokens. A long word is in it only if it is among the first.
    rank = F.col("token_id") - FIRST_WORD_ID
    hot = (rank < head_words) & ((F.octet_length("token") <= HEAD_WORD_BYTES) | (rank < head_words // 25))
    with small_batches(df.sparkSession):
        coded = materialize(
            df.select(key, _coder(vocab.where(hot), True)(tx.words(F.col(text))).alias("c"))
            .select(key, F.monotonically_increasing_id().alias("_row"), "c.ids", "c.rest"),
            "coded",
        )
    rare = coded.select("_row", F.posexplode("rest").alias("pos", "token")).join(vocab.where(~hot), "token", "left")
    # One long per token, place above id: sorts as a primitive array.
    mask = (1 << _POS_BITS) - 1
    packed = F.shiftleft(F.col("pos").cast("long"), _POS_BITS).bitwiseOR(
        F.coalesce(F.col("token_id").cast("long"), F.lit(mask))
    )
    found = rare.groupBy("_row").agg(F.sort_array(F.collect_list(packed)).alias("_packed"))
    number = F.transform("_packed", lambda p: F.shiftright(F.shiftleft(p, _POS_BITS), _POS_BITS).cast("int"))
    whole = coded.where(F.size("rest") == 0).select(key, "ids")
    met = coded.where(F.size("rest") > 0).select(key, "_row", "ids").join(found, "_row")
    return whole.unionByName(met.select(key, _filled("ids", number).alias("ids")))


def tokenize_with(
    df: DataFrame,
    encode: Callable[[list[str]], list[list[int]]],
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Same result shape from any batch encoder, such as a pretrained one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "ids": encode(batch[text].tolist())})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, ids array<int>")


def truncate_tokens(ids: Column, limit: int) -> Column:
    return F.slice(ids, 1, limit)


def add_bos_eos(ids: Column, bos: int = BOS_ID, eos: int = EOS_ID) -> Column:
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def sequences(tokenized: DataFrame, limit: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, seq): truncated ids between BOS and EOS."""
    ids = F.col("ids") if limit is None else truncate_tokens(F.col("ids"), limit)
    return tokenized.select(key, add_bos_eos(ids).alias("seq"))


def sequence_lengths(
    df: DataFrame, limit: int | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_tokens) with BOS and EOS, straight from the text.

    Equal to the sequence sizes where the vocabulary covers every word.
    """
    n = F.size(tx.words(F.col(text)))
    if limit is not None:
        n = F.least(n, F.lit(limit))
    return df.select(key, (n + 2).alias("n_tokens"))


def token_rows(seqs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per token with its position in the document; BOS is at 0."""
    return seqs.select(key, F.posexplode("seq").alias("tok_pos", "token_id"))


def token_counts(seqs: DataFrame, special: list[int] = (BOS_ID, EOS_ID)) -> DataFrame:
    """(token_id, n): how often each id stands in the sequences. Counts combine per task."""
    ids = seqs.select(F.explode("seq").alias("token_id"))
    return ids.where(~F.col("token_id").isin(*special)).groupBy("token_id").agg(F.count("*").alias("n"))


def first_uses(seqs: DataFrame, k: int, special: list[int] = (BOS_ID, EOS_ID), key: str = "doc_id") -> DataFrame:
    """(key, tok_pos, token_id): token rows less those that cannot be among the first ``k`` of their id.

    Each batch of documents keeps the first ``k`` uses of every id, by key and
    position, so the overall first ``k`` are always among them. Keys are numbers.
    """
    kind = dict(seqs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(~np.isin(ids, special))
            by_id = at[np.argsort(ids[at], kind="stable")]
            ordered = ids[by_id]
            first = np.sort(by_id[np.arange(len(ordered)) - np.searchsorted(ordered, ordered) < k])
            row = np.searchsorted(starts + sizes, first, side="right")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(first - starts[row], pa.int32()), pa.array(ids[first], pa.int32())],
                names=[key, "tok_pos", "token_id"],
            )

    return seqs.select(key, "seq").mapInArrow(run, f"`{key}` {kind}, tok_pos int, token_id int")


def kept_rank(tokens: DataFrame, special: list[int], chunk_len: int) -> DataFrame:
    """Token rows without special ids, with positions counted after the removal.

    The alternative numbering: chunk start plus rank among the kept tokens.
    Only the first chunk has a special token in front, so only there the
    position moves, by one.
    """
    moved = F.when(F.col("tok_pos") < chunk_len, F.col("tok_pos") - 1)
    return tokens.where(~F.col("token_id").isin(*special)).withColumn(
        "tok_pos", moved.otherwise(F.col("tok_pos"))
    )


def pad_to(seq: Column, length: Column | int, pad: int = EOS_ID) -> Column:
    """Fill up to ``length``; longer sequences stay as they are."""
    missing = F.greatest(F.lit(length) - F.size(seq), F.lit(0))
    return F.concat(seq, F.array_repeat(F.lit(pad), missing))


def attention_mask(real: Column, length: Column | int) -> Column:
    """1 for each of ``real`` leading tokens, 0 up to ``length``."""
    missing = F.greatest(F.lit(length) - real, F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), missing))


def assign_batches(
    df: DataFrame,
    size: int,
    key: str = "doc_id",
    out: str = "batch_id",
    splits: list[float] | None = None,
) -> DataFrame:
    """Mini-batches of ``size`` consecutive rows; the last may be short."""
    return (
        index_documents(df, key, "_idx", splits)
        .withColumn(out, F.expr(f"_idx div {int(size)}"))
        .drop("_idx")
    )


def pad_batch(
    seqs: DataFrame,
    size: int,
    key: str = "doc_id",
    pad: int = EOS_ID,
    splits: list[float] | None = None,
) -> DataFrame:
    """Pad to the longest sequence of each batch of ``size`` documents.

    A window holds the ``size`` rows of one batch.
    """
    longest = F.max(F.size("seq")).over(Window.partitionBy("batch_id"))
    batched = assign_batches(seqs, size, key, splits=splits).withColumn("_longest", longest)
    return batched.select(
        "batch_id",
        key,
        pad_to(F.col("seq"), F.col("_longest"), pad).alias("input_ids"),
        attention_mask(F.size("seq"), F.col("_longest")).alias("attention_mask"),
    )


def chunk(seqs: DataFrame, length: int, keep_tail: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, start, ids): blocks of ``length`` within each document.

    Without ``keep_tail`` the remainder is left out, and with it any document
    shorter than one block.
    """
    n = F.size("seq")
    count = F.ceil(n / length) if keep_tail else F.floor(n / length)
    return (
        seqs.withColumn("_n", count.cast("int"))
        .where("_n > 0")
        .select(key, "seq", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
        .select(
            key,
            (F.col("_i") * length).alias("start"),
            F.slice("seq", F.col("_i") * length + 1, F.lit(length)).alias("ids"),
        )
    )


def context_cut(ids: Column, limit: int) -> Column:
    return F.slice(ids, 1, limit)


def rebuild_text(
    tokens: DataFrame,
    vocab: DataFrame,
    key: str = "doc_id",
    broadcast_words: int = BROADCAST_WORDS,
    head_words: int = HEAD_WORDS // 25,
) -> DataFrame:
    """The words of each document joined again from its token rows.

    A group is one document, which already was one row of the corpus.
    """
    lookup = vocab.select("token", "token_id")
    if _small(lookup, broadcast_words):
        named = tokens.join(F.broadcast(lookup), "token_id")
    else:
        last = FIRST_WORD_ID + head_words
        hot = F.col("token_id") < last
        named = (
            tokens.where(hot).join(F.broadcast(lookup.where(hot)), "token_id")
            .unionByName(tokens.where(~hot).join(lookup.where(~hot), "token_id"))
        )
    parts = F.sort_array(F.collect_list(F.struct("tok_pos", "token")))
    return named.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["token"]), " ").alias("text")
    )
