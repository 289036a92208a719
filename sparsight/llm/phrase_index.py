"""Benchmark decontamination on a positional inverted index of the training tokens.

The index is cut by documents: a shard holds the postings of some documents,
one row per term, as positions in the shard. A search is sent to every shard,
starts at the rarest term of each query there, and intersects the lists of the
other terms, shifted by their offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from sparsight.llm.words import LOWER_ALNUM, bounded, coded
from sparsight.session import materialize

WINDOW = 10
SHARD_BYTES = 12 << 20
#: bytes of queries that go to every shard at once; more are searched in blocks
QUERY_BYTES = 8 << 20
_CANDIDATES = 1 << 20

INDEX = "shard bigint, term string, positions array<int>, doc_ids array<{id}>"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, written to shared storage.

    ``shard, term, positions`` per term; the row without a term holds the ids
    of the shard's documents in ``doc_ids`` and where each starts, and the end,
    in ``positions``. Null and empty texts are documents without positions.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in bounded(batches, "t", SHARD_BYTES):
            codes, offsets, words = coded(batch.column("t"), LOWER_ALNUM)
            order = np.argsort(codes, kind="stable").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(words)))])
            n = len(words)
            ids = batch.column("i")
            postings = pa.ListArray.from_arrays(
                pa.array(np.append(ends, ends[-1] + len(offsets)).astype(np.int32)),
                pa.array(np.concatenate([order, offsets.astype(np.int32)])),
            )
            owners = pa.ListArray.from_arrays(
                pa.array(np.append(np.zeros(n + 1, np.int32), np.int32(len(ids)))), ids,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, (task << 32) + count, np.int64)),
                    pa.concat_arrays([words, pa.nulls(1, pa.string())]), postings, owners,
                ],
                ["shard", "term", "positions", "doc_ids"],
            )
            count += 1

    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return materialize(rows.mapInArrow(run, INDEX.format(id=kind)), "postings")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """``terms, item_ids``: each distinct window of ``width`` words, with the items that hold it.

    An item of fewer words is one window; one without words has none.
    """
    kind = items.schema[item_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "t"):
            codes, offsets, words = coded(batch.column("t"), LOWER_ALNUM)
            terms, owners = [], []
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                for s in range(a, max(b - width, a) + 1) if b > a else ():
                    terms.append(codes[s : min(s + width, b)])
                    owners.append(k)
            flat = words.take(pa.array(np.concatenate(terms or [codes[:0]])))
            ends = np.cumsum([0, *map(len, terms)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("i").take(pa.array(owners, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), flat)],
                ["item_id", "terms"],
            )

    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    cut = rows.mapInArrow(run, f"item_id {kind.simpleString()}, terms array<string>")
    return cut.groupBy("terms").agg(F.collect_set("item_id").alias("item_ids"))


class _Postings:
    """The lists of one shard for the terms of a query block."""

    def __init__(self, terms: list[str | None], lists: pa.Array, number: dict[str, int]):
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        self.count = np.zeros(len(number) + 1, np.int64)
        rows = sorted((number[t], i) for i, t in enumerate(terms) if t is not None)
        parts = [values[ends[i] : ends[i + 1]] for _, i in rows]
        for (v, _), part in zip(rows, parts):
            self.count[v] = len(part)
        self.positions = np.concatenate([values[:0], *parts])
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.keys = (np.repeat([v for v, _ in rows], [len(p) for p in parts]).astype(np.int64) << 32) + self.positions

    def holds(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each term stands at each position."""
        keys = (term << 32) + at
        found = np.searchsorted(self.keys, keys)
        return (at >= 0) & (self.keys[np.minimum(found, len(self.keys) - 1)] == keys)

    def starts(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``query, start`` of every place where the terms (-1: none) of a query stand in a row."""
        number = np.where(terms < 0, len(self.count) - 1, terms)
        seen = np.where(terms < 0, np.iinfo(np.int64).max, self.count[number])
        alive = np.flatnonzero((seen > 0).all(axis=1))
        rarest = np.argsort(seen[alive], axis=1, kind="stable")
        total = np.cumsum(seen[alive, rarest[:, 0]] if len(alive) else [])
        cuts = np.flatnonzero(np.diff(total // _CANDIDATES)) + 1 if len(alive) else []
        for rows, order in zip(np.split(alive, cuts), np.split(rarest, cuts)):
            if not len(rows):
                continue
            anchor = terms[rows, order[:, 0]]
            n = self.count[anchor]
            query = np.repeat(np.arange(len(rows)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[anchor], n)
            start = self.positions[place].astype(np.int64) - order[query, 0]
            for j in range(1, terms.shape[1]):
                offset = order[query, j]
                term = terms[rows[query], offset]
                ok = (term < 0) | self.holds(term, start + offset)
                query, start = query[ok], start[ok]
            yield rows[query], start


def _block_count(queries: DataFrame, limit: int) -> int:
    """How many blocks of bounded size the query rows make, by hash."""
    size = queries.agg(F.sum(F.length(F.concat_ws(" ", "terms")) + 8 * F.size("item_ids") + 64)).first()[0] or 0
    return 1 + int(2 * size // limit) if size > limit else 1


def _searched(index: DataFrame, rows: list, kind: str) -> tuple[DataFrame, Broadcast]:
    """One block of queries against every shard: a row per document. And what was sent for it."""
    spark = index.sparkSession
    terms = sorted({t for r in rows for t in r.terms})
    number = {t: i for i, t in enumerate(terms)}
    width = max([1, *(len(r.terms) for r in rows)])
    table = np.full((len(rows), width), -1, np.int64)
    for i, r in enumerate(rows):
        table[i, : len(r.terms)] = [number[t] for t in r.terms]
    lengths = (table >= 0).sum(axis=1)
    ids = sorted({i for r in rows for i in r.item_ids})
    place = {i: k for k, i in enumerate(ids)}
    owners = [np.array([place[i] for i in r.item_ids], np.int64) for r in rows]
    owner_n = np.array([len(o) for o in owners], np.int64)
    owner_first = np.cumsum(owner_n) - owner_n
    owner_flat = np.concatenate(owners) if owners else np.empty(0, np.int64)
    id_type = index.schema["doc_ids"].dataType.elementType
    sent = spark.sparkContext.broadcast((number, table, lengths, ids, owner_n, owner_first, owner_flat))

    def search(group: pa.Table) -> pa.Table:
        number, table, lengths, ids, owner_n, owner_first, owner_flat = sent.value
        group = group.combine_chunks()
        names = group.column("term").to_pylist()
        lists = group.column("positions").chunk(0)
        if lists.offset:
            lists = pa.concat_arrays([lists.slice(0, 0), lists])
        here = _Postings(names, lists, number)
        head = names.index(None)
        offsets = np.array(group.column("positions")[head].as_py(), np.int64)
        docs = group.column("doc_ids")[head].values
        n_docs, end = len(docs), int(offsets[-1])
        diff, pairs = np.zeros(end + 1, np.int64), [np.empty(0, np.int64)]
        if len(table) and len(here.keys):
            for query, start in here.starts(table):
                stop = start + lengths[query]
                doc = np.searchsorted(offsets, start, "right") - 1
                inside = (start >= 0) & (stop <= offsets[np.minimum(doc + 1, n_docs)])
                query, start, stop, doc = query[inside], start[inside], stop[inside], doc[inside]
                np.add.at(diff, start, 1)
                np.add.at(diff, stop, -1)
                n = owner_n[query]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(owner_first[query], n)
                pairs.append(np.unique(np.repeat(doc, n) * max(1, len(ids)) + owner_flat[at]))
        hit = np.cumsum(diff[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        pairs = np.unique(np.concatenate(pairs))
        doc, item = pairs // max(1, len(ids)), pairs % max(1, len(ids))
        # runs of hit words, cut at the ends of documents
        a, b = edge[::2], edge[1::2]
        inner = offsets[1:-1]
        inner = inner[hit[inner - 1] & hit[np.minimum(inner, end - 1)]] if end and len(inner) else inner[:0]
        inner = np.unique(inner[(inner > 0) & (inner < end)])
        a, b = np.sort(np.concatenate([a, inner])), np.sort(np.concatenate([b, inner]))
        run_doc = np.searchsorted(offsets, a, "right") - 1
        run_ends = np.concatenate([[0], np.cumsum(np.bincount(run_doc, minlength=n_docs))]).astype(np.int32)
        item_ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))]).astype(np.int32)
        base = offsets[run_doc] if len(a) else a
        return pa.table({
            "shard": pa.array(np.full(n_docs, group.column("shard")[0].as_py(), np.int64)),
            "number": pa.array(np.arange(n_docs, dtype=np.int32)),
            "doc_id": docs,
            "n_words": pa.array(np.diff(offsets)),
            "starts": pa.ListArray.from_arrays(pa.array(run_ends), pa.array((a - base).astype(np.int64))),
            "ends": pa.ListArray.from_arrays(pa.array(run_ends), pa.array((b - base).astype(np.int64))),
            "item_ids": pa.ListArray.from_arrays(
                pa.array(item_ends), pa.array(ids, kind_arrow).take(pa.array(item)) if ids else pa.array([], kind_arrow)
            ),
        })

    from pyspark.sql.pandas.types import to_arrow_type

    kind_arrow = to_arrow_type(kind)
    vocabulary = spark.createDataFrame([(t,) for t in terms], "term string")
    read = index.join(F.broadcast(vocabulary), "term", "left_semi").unionByName(index.where("term is null"))
    schema = (
        f"shard bigint, number int, doc_id {id_type.simpleString()}, n_words bigint, starts array<bigint>, "
        f"ends array<bigint>, item_ids array<{kind.simpleString()}>"
    )
    return read.groupBy("shard").applyInArrow(search, schema), sent


def exact_matches(index: DataFrame, queries: DataFrame, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Per document: ``doc_id, n_words, starts, ends, item_ids``.

    ``starts`` and ``ends`` are the runs of words inside an occurring window
    (of several blocks: possibly overlapping), ``item_ids`` the items with an
    occurring window. Documents without a match have empty lists.
    """
    kind = queries.schema["item_ids"].dataType.elementType
    blocks = _block_count(queries, query_bytes)
    if blocks == 1:
        found, _ = _searched(index, queries.collect(), kind)
    else:
        # one block at a time: its result is written and what was sent for it is given up before the next is read
        written = materialize(queries, "windows")
        parts = []
        for k in range(blocks):
            part, sent = _searched(index, written.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == k).collect(), kind)
            # documents without a match are named once
            parts.append(materialize(part if k == 0 else part.where(F.size("starts") > 0), "matches"))
            sent.destroy()
        found = reduce(DataFrame.unionByName, parts)
        flat = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "item_ids")}
        found = found.groupBy("shard", "number").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *flat.values()
        )
    return found.select("doc_id", "n_words", "starts", "ends", F.array_distinct("item_ids").alias("item_ids"))


def covered(starts, ends):
    """The number of words in a union of runs given as two arrays of equal length."""
    runs = F.array_sort(F.arrays_zip(starts.alias("s"), ends.alias("e")))
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    return F.aggregate(
        runs, state,
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], r["e"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )


def proximity_matches(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """``doc_id, start, end``: places where all ``terms`` stand within ``span`` words of one document.

    Each place starts at one of the terms and ends after the nearest later
    occurrence of the last of the others. Terms are few and given by the caller.
    """
    wanted = sorted(set(terms))
    id_type = index.schema["doc_ids"].dataType.elementType

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        names = group.column("term").to_pylist()
        head = names.index(None)
        offsets = np.array(group.column("positions")[head].as_py(), np.int64)
        docs = group.column("doc_ids")[head].values
        lists = [np.array(group.column("positions")[names.index(t)].as_py(), np.int64) for t in wanted if t in names]
        start, end = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(lists) == len(wanted) and wanted:
            start = np.unique(np.concatenate(lists))
            end = start.copy()
            for places in lists:
                at = np.searchsorted(places, start)
                end = np.maximum(end, np.append(places, np.iinfo(np.int64).max - 1)[at])
            end = end + 1
            doc = np.searchsorted(offsets, start, "right") - 1
            ok = (end - start <= span) & (end <= offsets[doc + 1])
            start, end = start[ok], end[ok]
        doc = np.searchsorted(offsets, start, "right") - 1
        base = offsets[doc] if len(doc) else doc
        return pa.table({"doc_id": docs.take(pa.array(doc)), "start": pa.array(start - base), "end": pa.array(end - base)})

    read = index.where(F.col("term").isNull() | F.col("term").isin(wanted))
    return read.groupBy("shard").applyInArrow(search, f"doc_id {id_type.simpleString()}, start bigint, end bigint")


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", width: int = WINDOW,
) -> DataFrame:
    """``exact_matches`` of the windows of ``benchmark`` in ``docs``.

    Nulls: a null text has no words; an item without an id marks words but is
    not named. Repeated documents are judged each for itself, repeated items
    once. An empty benchmark leaves every document clean.
    """
    return exact_matches(build_index(docs, doc_id, text), windows(benchmark, item_id, item_text, width))
