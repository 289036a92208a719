"""Batch inference: from token blocks to one activation row per token."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from sparsight.functions.vectors import (
    bf16_codes, bf16_values, f16_codes, f16_values, from_matrix,
)
from sparsight.operators.filters import drop_special
from sparsight.operators.joins import lookup_join
from sparsight.operators.ordering import running_total
from sparsight.session import materialize

MAX_MODEL_BYTES = 64 << 20
TOKENS_AT_ONCE = 256
ROWS_OUT = 4_096

Model = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class GatedMlp:
    """A stack of gated layers with given weights: ``down(silu(gate x) * (up x))``.

    ``embedding`` has one row per id, taken modulo their number; ``layers``
    hold (gate, up, down), each hidden x width, and their outputs are added to
    what goes into the next one. Call it with ids (rows, tokens) to get the
    outputs of the layers in ``kept``, (kept, rows, tokens, width), or of the
    only one without the first axis. Layers above the last kept one are not
    computed. The weights travel with the job: ``MAX_MODEL_BYTES`` at most.
    """

    embedding: np.ndarray
    layers: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]
    kept: tuple[int, ...] = (0,)
    max_tokens: int | None = None

    def __post_init__(self) -> None:
        if self.embedding.nbytes + sum(w.nbytes for layer in self.layers for w in layer) > MAX_MODEL_BYTES:
            raise ValueError("weights exceed what is sent with a job: load them in the worker instead")
        if not self.kept or max(self.kept) >= len(self.layers):
            raise ValueError("no such layer")

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if self.max_tokens is not None and ids.shape[1] > self.max_tokens:
            raise MemoryError(f"sequence exceeds {self.max_tokens} tokens")
        flat = ids.ravel() % len(self.embedding)
        whole = np.empty((len(self.kept), len(flat), self.layers[0][2].shape[1]))
        # every token goes through the layers, a stretch at a time that stays in the cache
        for at in range(0, len(flat), TOKENS_AT_ONCE):
            x = self.embedding[flat[at : at + TOKENS_AT_ONCE]]
            for depth, (gate, up, down) in enumerate(self.layers[: max(self.kept) + 1]):
                gated = x @ gate.T
                output = (gated / (1.0 + np.exp(-gated)) * (x @ up.T)) @ down
                for place, kept in enumerate(self.kept):
                    if kept == depth:
                        whole[place, at : at + TOKENS_AT_ONCE] = output
                x = x + output
        whole = whole.reshape(len(self.kept), *ids.shape, -1)
        return whole if len(self.kept) > 1 else whole[0]


def align_blocks(blocks: DataFrame) -> DataFrame:
    """(block_id, docs, positions, ids) of equal length, from packed segments."""
    s = F.col("segments")
    return blocks.select(
        "block_id",
        F.flatten(
            F.transform(s, lambda x: F.array_repeat(x["doc_id"], F.size(x["ids"])))
        ).alias("docs"),
        F.flatten(
            F.transform(
                s, lambda x: F.sequence(x["start"], x["start"] + F.size(x["ids"]) - 1)
            )
        ).alias("positions"),
        F.flatten(F.transform(s, lambda x: x["ids"])).alias("ids"),
    )


def number_rows(aligned: DataFrame, special: Sequence[int] = (0, 1)) -> DataFrame:
    """``aligned`` with ``first_row``: how many kept tokens stand in the blocks before.

    The rows of a run can so be numbered without a gap before the model makes
    vectors of them; only blocks of ids are ordered. Block ids are unique.
    """
    kept = F.size(F.filter("ids", lambda t: ~t.isin(list(special))))
    return running_total(materialize(aligned, "blocks"), "block_id", kept, "first_row")


def number_tokens(
    seqs: DataFrame, lengths: DataFrame, key: str = "doc_id", splits: list[float] | None = None
) -> DataFrame:
    """(key, tok_pos, token_id, row_id): all tokens but BOS and EOS, numbered in order without a gap.

    Arguments and order as in ``number_sequences``.
    """
    placed = number_sequences(seqs, lengths, key, splits).withColumnRenamed("first_row", "_first")
    rows = placed.select(key, "_first", F.posexplode("seq").alias("tok_pos", "token_id"), F.size("seq").alias("_n"))
    return rows.where("tok_pos > 0 AND tok_pos < _n - 1").select(
        key, "tok_pos", "token_id", (F.col("_first") + F.col("tok_pos") - 1).alias("row_id")
    )


def number_sequences(
    seqs: DataFrame, lengths: DataFrame, key: str = "doc_id", splits: list[float] | None = None
) -> DataFrame:
    """(key, seq, first_row): how many tokens but BOS and EOS stand in the sequences before.

    ``lengths`` has the sizes of the sequences, so that offsets come from it
    and no sequence is made twice. Rows leave in the order of keys within a task.
    """
    words = lengths.select(key, (F.col("n_tokens") - 2).alias("n"))
    return running_total(seqs, key, F.size("seq") - 2, "first_row", splits, words)


def align_sequences(numbered: DataFrame, length: int, key: str = "doc_id") -> DataFrame:
    """Numbered sequences as aligned blocks of ``length`` tokens of single documents, in their order.

    The last block of a document may be short. ``first_row`` of a block leaves
    out BOS, as ``number_sequences`` does.
    """
    start = F.col("_start")
    blocks = numbered.select(
        key, "seq", "first_row", F.explode(F.sequence(F.lit(0), F.size("seq") - 1, F.lit(length))).alias("_start")
    ).select(key, "first_row", "_start", F.slice("seq", start + 1, F.lit(length)).alias("ids"))
    n = F.size("ids")
    return blocks.select(
        F.col(key).alias("block_id"),
        F.array_repeat(key, n).alias("docs"),
        F.sequence(start, start + n - 1).alias("positions"),
        "ids",
        (F.col("first_row") + F.greatest(start - 1, F.lit(0))).alias("first_row"),
    )


def align_chunks(chunks: DataFrame) -> DataFrame:
    """The same columns from chunks of single documents."""
    n = F.size("ids")
    return chunks.select(
        F.xxhash64("doc_id", "start").alias("block_id"),
        F.array_repeat("doc_id", n).alias("docs"),
        F.sequence(F.col("start"), F.col("start") + n - 1).alias("positions"),
        "ids",
    )


_OUT = pa.schema(
    [
        ("block_id", pa.int64()), ("doc_id", pa.int64()), ("tok_pos", pa.int32()),
        ("token_id", pa.int32()), ("activation", pa.list_(pa.float32())), ("error", pa.string()),
    ]
)


def extract_activations(
    aligned: DataFrame,
    model: Model,
    special: Sequence[int] = (0, 1),
    rows_per_call: int = 16,
    on_error: str = "raise",
    layers: Sequence[int] | None = None,
    values: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None,
    as_bytes: bool = False,
) -> DataFrame:
    """Run ``model`` over aligned blocks, one row per token that is kept.

    Tokens with special ids take part in the run and are dropped after it.
    With ``on_error='quarantine'`` a batch that fails is tried again block by
    block; a block that still fails becomes one row holding the error text,
    and the job goes on. Split the result with ``succeeded`` and ``failed``.

    ``layers`` names the layers of a model that returns several at once; each
    token then has one row per layer, told apart by ``layer``. Blocks from
    ``number_rows`` or ``align_sequences`` give rows their ``row_id``, the place
    of the token among all kept ones, and leave in the order they came in.
    ``values`` are numbers that are wanted of a vector instead of it, each made
    in the run from the float vectors of a call, as doubles. With ``as_bytes``
    a vector is the bytes of its floats, which are moved as one, see
    ``vectors.f32_bytes_to_floats``.
    """
    numbered = "first_row" in aligned.columns
    run, out = activation_run(model, special, rows_per_call, on_error, layers, values, as_bytes, numbered)
    columns = ["block_id", "docs", "positions", "ids", *(["first_row"] if numbered else [])]
    return aligned.select(*columns).mapInArrow(run, from_arrow_schema(out))


def activation_run(
    model: Model,
    special: Sequence[int] = (0, 1),
    rows_per_call: int = 16,
    on_error: str = "raise",
    layers: Sequence[int] | None = None,
    values: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None,
    as_bytes: bool = False,
    numbered: bool = False,
) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], pa.Schema]:
    """What ``extract_activations`` does to the Arrow batches of a task, and the columns it gives.

    For those who use the rows in the worker that makes them.
    """
    if as_bytes and values is not None:
        raise ValueError("there are no vectors beside values")
    drop = np.array(sorted(special), dtype=np.int64)
    out = _OUT
    if values is not None:
        at = out.get_field_index("activation")
        fields = [f for f in out if f.name != "activation"]
        out = pa.schema([*fields[:at], *(pa.field(name, pa.float64()) for name in values), *fields[at:]])
    if numbered:
        out = out.append(pa.field("row_id", pa.int64()))
    if layers is not None:
        out = out.append(pa.field("layer", pa.int32()))

    if as_bytes:
        out = out.set(out.get_field_index("activation"), pa.field("activation", pa.binary()))

    def of_vectors(vectors: np.ndarray) -> list[pa.Array]:
        if as_bytes:
            ends = np.arange(len(vectors) + 1, dtype=np.int32) * (4 * vectors.shape[1])
            whole = np.ascontiguousarray(vectors, "<f4")
            return [pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(whole)])]
        if values is None:
            return [from_matrix(vectors, pa.float32()) if len(vectors) else pa.array([], pa.list_(pa.float32()))]
        return [pa.array(np.asarray(make(vectors.astype(np.float64))), pa.float64()) for make in values.values()]

    def rows_of(block_ids, docs, positions, ids, first) -> Iterator[pa.RecordBatch]:
        kept = ~np.isin(ids, drop)
        whole = model(ids)
        for number, values in zip(layers, whole) if layers is not None else ((None, whole),):
            vectors = values[kept].astype(np.float32)
            n = len(vectors)
            columns = [
                pa.array(np.repeat(block_ids, ids.shape[1])[kept.ravel()], pa.int64()),
                pa.array(docs[kept], pa.int64()),
                pa.array(positions[kept], pa.int32()),
                pa.array(ids[kept], pa.int32()),
                *of_vectors(vectors),
                pa.nulls(n, pa.string()),
            ]
            if numbered:
                place = first[:, None] + np.cumsum(kept, axis=1) - 1
                columns.append(pa.array(place[kept], pa.int64()))
            if layers is not None:
                columns.append(pa.array(np.full(n, number), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    def error_row(block_ids, docs, error: Exception) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [
                {
                    "block_id": int(block_ids[0]), "doc_id": int(docs[0, 0]),
                    "error": f"{type(error).__name__}: {error}",
                }
            ],
            schema=out,
        )

    def attempt(parts) -> Iterable[pa.RecordBatch]:
        try:
            made = list(rows_of(*parts))
        except Exception as error:
            if on_error != "quarantine":
                raise
            if len(parts[0]) == 1:
                yield error_row(parts[0], parts[1], error)
                return
            for i in range(len(parts[0])):
                yield from attempt([p[i : i + 1] for p in parts])
        else:
            yield from made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block_ids = batch.column("block_id").to_numpy(zero_copy_only=False)
            first = batch.column("first_row").to_numpy(zero_copy_only=False) if numbered else block_ids
            flat, starts = [], []
            for name in ("docs", "positions", "ids"):
                column = batch.column(name)
                lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
                flat.append(column.flatten().to_numpy(zero_copy_only=False))
                starts.append(np.cumsum(lengths, dtype=np.int64) - lengths)
            # Calls take blocks of one length; only tails differ. Numbered blocks keep their order.
            if numbered:
                alike = np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(lengths)) + 1)
            else:
                alike = [np.flatnonzero(lengths == n) for n in np.unique(lengths)]
            for where in alike:
                length = lengths[where[0]] if len(where) else 0
                if not length > 0:
                    continue
                for at in range(0, len(where), rows_per_call):
                    rows = where[at : at + rows_per_call]
                    within = np.arange(length)
                    cells = [f[s[rows][:, None] + within] for f, s in zip(flat, starts)]
                    yield from attempt([block_ids[rows], *cells, first[rows]])

    return lambda batches: _gathered(run(batches)), out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``ROWS_OUT`` and more: each batch costs a message."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_OUT:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def succeeded(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NULL").drop("error")


def failed(rows: DataFrame) -> DataFrame:
    """The blocks that failed, a row for each row or token of them that tells so."""
    return rows.where("error IS NOT NULL").select("block_id", "doc_id", "error")


def with_vec_id(tokens: DataFrame, n: int) -> DataFrame:
    return tokens.withColumn("vec_id", F.pmod(F.col("token_id").cast("long"), F.lit(n)))


def lookup_activations(
    tokens: DataFrame, vectors: DataFrame, width: int = 64, columns: Sequence[Column] | None = None, salts: int = 32
) -> DataFrame:
    """Stand-in model for checks: a token's vector is ``token_id mod n`` of a table.

    Frequent tokens make hot keys, see ``lookup_join``; rows of distinct ids
    need no ``salts``. ``columns`` are values of 8 bytes each that are wanted of
    a vector instead of it: they are made once per vector, not per token.
    """
    table = vectors.select("vec_id", *(columns or ["activation"]))
    size = 24 + 8 * len(columns) if columns else 8 * width + 32
    return lookup_join(with_vec_id(tokens, vectors.count()), table, ["vec_id"], row_bytes=size, salts=salts).drop("vec_id")


def layer_activations(
    tokens: DataFrame, layers: DataFrame, n: int, width: int = 64, columns: Sequence[Column] | None = None
) -> DataFrame:
    """One row per token and layer, from a table of stored vectors (``layer, vec_id, activation``).

    The vector of a token is that with ``vec_id = token_id mod n`` in each
    layer; ``columns`` as in ``lookup_activations``.
    """
    table = layers.select("layer", "vec_id", *(columns or ["activation"]))
    size = 24 + 8 * len(columns) if columns else 8 * width + 48
    return lookup_join(with_vec_id(tokens, n), table, ["vec_id"], row_bytes=size).drop("vec_id")


def unusable_vectors(vectors: DataFrame, n: int, width: int) -> DataFrame:
    """(vec_id, error): the ids below ``n`` that have no vector, or one of another width or with strange values."""
    cells = F.col("activation")
    hi, lo, endless = F.array_max(cells), F.array_min(cells), F.lit(float("inf"))
    error = (
        F.when(cells.isNull(), "no vector").when(F.size(cells) != width, "wrong width")
        .when(F.exists(cells, lambda x: x.isNull()) | F.isnan(hi) | (hi == endless) | (lo == -endless), "not finite")
    )
    ids = vectors.sparkSession.range(n).withColumnRenamed("id", "vec_id")
    return ids.join(vectors.select("vec_id", "activation"), "vec_id", "left").select("vec_id", error.alias("error")).where("error IS NOT NULL")


def quarantine(tokens: DataFrame, unusable: DataFrame, n: int, block: Sequence[str] = ("block_id",)) -> DataFrame:
    """``tokens`` with ``error``: null, or why the block they stand in cannot be given vectors.

    No vector moves: only the ids that have none meet the tokens. A group is
    one block. Split the result with ``succeeded`` and ``failed``.
    """
    keyed = tokens.withColumn("vec_id", F.pmod(F.col("token_id").cast("long"), F.lit(n)))
    told = lookup_join(keyed, unusable, ["vec_id"], row_bytes=64, how="left").drop("vec_id")
    return told.withColumn("error", F.min("error").over(Window.partitionBy(*block)))


def activation_rows(matrices: DataFrame, special: Sequence[int] = (0, 1)) -> DataFrame:
    """Unroll (doc_id, ids, activacion): one row per token, special ids dropped."""
    rows = matrices.select(
        "doc_id", F.posexplode(F.arrays_zip("ids", "activacion")).alias("tok_pos", "cell")
    ).select(
        "doc_id", "tok_pos", F.col("cell.ids").alias("token_id"),
        F.col("cell.activacion").alias("activation"),
    )
    return drop_special(rows, list(special))


def explode_matrix(matrices: DataFrame, column: str = "activacion") -> DataFrame:
    """One vector per row, numbered within the document."""
    return matrices.select("doc_id", F.posexplode(column).alias("tok_pos", "activation"))


def compact_bf16(acts: DataFrame, column: str = "activation") -> DataFrame:
    """Codes of 16 bits instead of floats, with the codec named in each row."""
    return acts.withColumn(column, bf16_codes(column)).withColumn("codec", F.lit("bf16"))


def expand_bf16(acts: DataFrame, column: str = "activation") -> DataFrame:
    return acts.withColumn(column, bf16_values(column)).drop("codec")


def compact_f16(acts: DataFrame, column: str = "activation") -> DataFrame:
    return acts.withColumn(column, f16_codes(column)).withColumn("codec", F.lit("fp16"))


def expand_f16(acts: DataFrame, column: str = "activation") -> DataFrame:
    return acts.withColumn(column, f16_values(column)).drop("codec")


def compaction_report(acts: DataFrame, codec: str = "bf16", by: str = "split") -> DataFrame:
    """Largest error and byte counts per group of a 16-bit rewrite."""
    codes = {"bf16": bf16_codes, "fp16": f16_codes}[codec]("activation")
    values = {"bf16": bf16_values, "fp16": f16_values}[codec]
    pairs = acts.select(by, "activation", codes.alias("_codes")).select(
        by, F.arrays_zip(F.col("activation").alias("x"), values("_codes").alias("y")).alias("_xy")
    )
    cells = pairs.select(by, F.posexplode("_xy").alias("_pos", "c"))
    error = F.abs(F.col("c.x").cast("double") - F.col("c.y").cast("double"))
    return cells.groupBy(by).agg(
        F.count_if(F.col("_pos") == 0).alias("n_rows"),
        F.max(error).alias("max_error"),
        (F.count("*") * 4).alias("bytes_float"),
        (F.count("*") * 2).alias("bytes_codes"),
    )
