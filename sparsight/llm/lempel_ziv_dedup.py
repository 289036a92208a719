"""Substring dedup by relative Lempel-Ziv parsing against all earlier documents.

The reference of a document is every document with a smaller id. Its index
holds, for each phrase chosen by content, the smallest id that has it. A
document is parsed greedily into factors copied from the reference; where
phrases leave it open how far a factor reaches, the windows at its boundary are
looked up themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sparsight.llm.words import KEEP_CASE, bounded, coded, grams, hashed, mixed
from sparsight.session import materialize

WINDOW = 13
PHRASE = 4
_COMMON = np.uint64(1 << 63)


class Parsed:
    """Windows of a bounded piece of texts, and the phrase that stands for each.

    Of the phrases in a window the one with the smallest hash is chosen;
    phrases of short words come last, as they are common. Equal windows
    therefore have equal phrases.
    """

    def __init__(self, texts: pa.Array, width: int = WINDOW, phrase: int = PHRASE):
        self.codes, self.offsets, self.words = coded(texts, KEEP_CASE)
        h = hashed(self.words)
        size = pc.binary_length(self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens, lengths = h[self.codes], size[self.codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        chosen = grams(tokens, phrase) >> np.uint64(1)
        if len(chosen):
            letters = total[phrase:] - total[:-phrase]
            chosen[letters <= 3 * phrase] |= _COMMON
        span = width - phrase + 1
        n = max(0, len(tokens) - width + 1)
        least, reach = chosen, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:]) if len(least) > reach else least[:0]
            reach *= 2
        if span > reach:
            gap = span - reach
            least = np.minimum(least[:-gap], least[gap:]) if len(least) > gap else least[:0]
        self.hash = grams(tokens, width)
        self.phrase = least[:n]
        counts = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(counts)), counts)[:n]
        room = np.repeat(self.offsets[1:], counts)[:n] - np.arange(n)
        self.inside = room >= width
        self.width = width

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``doc, phrase, context`` of each run of windows with one phrase, cut at ``width`` windows."""
        at = np.flatnonzero(self.inside)
        if not len(at):
            return at, self.phrase[:0], self.phrase[:0]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(self.doc[at]) > 0) | (self.phrase[at[1:]] != self.phrase[at[:-1]])
        first = np.flatnonzero(new)
        step = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        new = step % self.width == 0
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        a, b = at[first], at[last]
        context = mixed(self.hash[a] + mixed(self.hash[b] + (b - a).astype(np.uint64)))
        return self.doc[a], self.phrase[a], context


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _phrases(docs: DataFrame, width: int, with_context: bool) -> DataFrame:
    """``phrase, d[, context]`` of every document, each once per piece of texts."""
    kind = docs.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "t"):
            doc, phrase, context = Parsed(batch.column("t"), width).runs()
            order = np.lexsort((context, doc, phrase)) if with_context else np.lexsort((doc, phrase))
            doc, phrase, context = doc[order], phrase[order], context[order]
            new = np.ones(len(doc), bool)
            new[1:] = (phrase[1:] != phrase[:-1]) | (doc[1:] != doc[:-1])
            if with_context:
                new[1:] |= context[1:] != context[:-1]
            ids = batch.column("d").take(pa.array(doc[new]))
            columns = [_signed(phrase[new]), ids, *([_signed(context[new])] if with_context else [])]
            yield pa.RecordBatch.from_arrays(columns, ["phrase", "d", "context"][: len(columns)])

    return docs.where("d is not null").mapInArrow(
        run, f"phrase bigint, d {kind}" + (", context bigint" if with_context else "")
    )


def _open_windows(rows: DataFrame, width: int) -> DataFrame:
    """``hash, d`` of the windows whose phrase stands in several contexts."""
    kind = rows.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "t"):
            parsed = Parsed(batch.column("t"), width)
            near = _lookup(parsed, batch.column("open"))[0]
            at = np.flatnonzero(near & parsed.inside)
            doc, h = parsed.doc[at], parsed.hash[at]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            yield pa.RecordBatch.from_arrays(
                [_signed(h[new]), batch.column("d").take(pa.array(doc[new]))], ["hash", "d"]
            )

    return rows.select("d", "t", "open").mapInArrow(run, f"hash bigint, d {kind}")


def _lookup(parsed: Parsed, lists: pa.Array, values: pa.Array | None = None, of: str = "phrase"):
    """Whether each window's phrase (or hash) is in its document's list, and the value beside it."""
    n = len(lists)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(n), counts)
    order = np.lexsort((keys, owner))
    keys, ends = keys[order], np.concatenate([[0], np.cumsum(counts)])
    found = np.zeros(len(parsed.phrase), bool)
    place = np.zeros(len(parsed.phrase), np.int64)
    wanted = getattr(parsed, of)
    bounds = np.searchsorted(parsed.doc, np.arange(n + 1))
    for i in np.flatnonzero(counts):
        a, b = bounds[i], bounds[i + 1]
        own = keys[ends[i] : ends[i + 1]]
        at = np.searchsorted(own, wanted[a:b])
        ok = own[np.minimum(at, len(own) - 1)] == wanted[a:b]
        found[a:b] = ok
        place[a:b] = order[ends[i] + np.minimum(at, len(own) - 1)]
    return found, place, (values.flatten() if values is not None else None)


def factors(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text, n_words, starts, ends, sources``.

    The lists are the parse: words ``starts`` to ``ends`` (exclusive) are a
    factor of at least ``width`` words whose windows start in a document with a
    smaller id; ``sources`` is the smallest id that has its first window. A
    factor is carried on greedily while each next window has the same source.
    Null and empty texts have no words; rows without an id are no reference and
    have no factors; rows with one id are no reference to each other.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    index = (
        _phrases(rows, width, True).groupBy("phrase")
        .agg(F.min("d").alias("first"), F.max("d").alias("last"), F.min("context").alias("low"), F.max("context").alias("high"))
        .where("first < last").select("phrase", "first", (F.col("low") != F.col("high")).alias("open"))
    )
    index = materialize(index, "reference")
    met = _phrases(rows, width, False).join(index, "phrase").where("open or first < d")
    lists = met.groupBy("d").agg(
        F.collect_list(F.when(F.col("open"), F.col("phrase"))).alias("open"),
        F.collect_list(F.when(~F.col("open"), F.struct("phrase", "first"))).alias("sure"),
    )
    lists = materialize(lists, "phrases")
    opened = rows.join(lists.where(F.size("open") > 0).select("d", "open"), "d")
    seen = _open_windows(opened, width)
    first = seen.groupBy("hash").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    first = materialize(first.select("hash", "first"), "windows")
    edges = seen.join(first, "hash").where("first < d").groupBy("d").agg(F.collect_list(F.struct("hash", "first")).alias("edge"))
    joined = rows.join(lists.select("d", "sure"), "d", "left").join(edges, "d", "left").select(
        "d", "t", F.col("sure.phrase").alias("p"), F.col("sure.first").alias("pf"),
        F.col("edge.hash").alias("w"), F.col("edge.first").alias("wf"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "t"):
            parsed = Parsed(batch.column("t"), width)
            n = len(parsed.phrase)
            sure, at, first = _lookup(parsed, batch.column("p"), batch.column("pf"))
            edge, at2, first2 = _lookup(parsed, batch.column("w"), batch.column("wf"), "hash")
            known = pa.concat_arrays([first, first2])
            place = np.where(sure, at, at2 + len(first))
            copied = np.flatnonzero((sure | edge) & parsed.inside)
            source = known.take(pa.array(place[copied]))
            number = source.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            doc = parsed.doc[copied]
            new = np.ones(len(copied), bool)
            new[1:] = (np.diff(copied) > 1) | (np.diff(doc) > 0) | (np.diff(number) != 0)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(copied)) - 1 if len(a) else a
            base = parsed.offsets[doc[a]]
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[a], minlength=batch.num_rows))]).astype(np.int32)
            nested = [
                pa.ListArray.from_arrays(pa.array(ends), x)
                for x in (
                    pa.array(copied[a] - base), pa.array(copied[b] + width - base), source.take(pa.array(a)),
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("t"), pa.array(np.diff(parsed.offsets)), *nested],
                ["doc_id", "text", "n_words", "starts", "ends", "sources"],
            )

    return joined.mapInArrow(
        run, f"doc_id {kind}, text string, n_words bigint, starts array<bigint>, ends array<bigint>, sources array<{kind}>"
    )


def without_factors(parsed: DataFrame) -> DataFrame:
    """The output of ``factors`` with ``n_removed`` and ``kept``, the words outside every factor, joined by a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, n, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "n_words", "starts", "ends"))):
                words = (text or "").encode().split()
                out = np.zeros(n, bool)
                for a, b in zip(starts, ends):
                    out[a:b] = True
                removed.append(int(out.sum()))
                kept.append(b" ".join([w for w, gone in zip(words, out.tolist()) if not gone]).decode())
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_removed", "kept"]
            )

    return parsed.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parsed.schema if f.name != "text") + ", n_removed bigint, kept string")
