"""Near-duplicates by SimHash, found through one-wildcard variants of three segments.

Fingerprints that differ in at most four bits differ in at most one bit in one
of three segments. Each fingerprint is therefore indexed under its three
segments with every single bit blanked in turn; equal keys meet in one sort,
and full fingerprints are verified there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparsight.llm.components import components
from sparsight.llm.words import bounded
from sparsight.session import materialize

SHINGLE = 4
MAX_BITS = 4
#: first bit and width of each segment
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_HASHES = 1 << 16
_DENSE = 8


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> bytes:
    """The SimHash of a text, eight bytes, highest first; zero without words."""
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _HASHES):
        h = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _HASHES], ends[at : at + _HASHES])])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(starts)).tobytes()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` holds the 64 bits as a long."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "t"):
            bits = b"".join([fingerprint(t, shingle) for t in batch.column("t").to_pylist()])
            fp = np.frombuffer(bits, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint")


def variants(fps: DataFrame) -> DataFrame:
    """``key, fp``: the 64 one-wildcard keys of each fingerprint, the blanked bit's number on top."""
    keys = []
    for first, width in SEGMENTS:
        part = F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1)
        for bit in range(width):
            keys.append(part.bitwiseAND(((1 << width) - 1) ^ (1 << bit)) + F.lit((first + bit) << 22))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _meet(a: np.ndarray, b: np.ndarray, key: np.ndarray | int, most: int) -> np.ndarray:
    """Whether fingerprints link and ``key`` is the first of the keys that they share."""
    x = a ^ b
    wild = np.full(x.shape, -1, np.int64)
    for first, width in reversed(SEGMENTS):
        part = (x >> np.uint64(first)) & np.uint64((1 << width) - 1)
        place = np.bitwise_count(part - np.uint64(1)).astype(np.int64)
        place[part == 0] = 0
        wild = np.where(np.bitwise_count(part) <= 1, first + place, wild)
    return (np.bitwise_count(x) <= most) & (wild == key)


def _spanning(fps: np.ndarray, key: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that is connected in a large group, at most one per member."""
    left, a, b = fps, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            u = front.pop()
            near = _meet(left, u, key, most)
            if near.any():
                hits = left[near]
                a.append(hits)
                b.append(np.full(len(hits), u, np.uint64))
                front.extend(hits)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


def _links(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links in sorted keys: all of small groups, spanning ones of large groups."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [fps[:0]], [fps[:0]]
    large = sizes > _DENSE
    small = np.repeat(~large, sizes)
    for lag in range(1, _DENSE):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
        if not len(i):
            break
        near = _meet(fps[i], fps[i + lag], keys[i] >> 22, most)
        a.append(fps[i][near])
        b.append(fps[i + lag][near])
    for s, n in zip(starts[large], sizes[large]):
        x, y = _spanning(fps[s : s + n], int(keys[s]) >> 22, most)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``a, b``: links between distinct fingerprints that leave the connected components whole.

    A task reads its keys in order and holds one group of equal keys at a time.
    A group of up to eight gives all its links; a larger one gives a spanning
    set, so that no group emits more rows than it has members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys, fps):
            a, b = _links(keys, fps, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            held.append((keys, fps))
            if held[0][0][-1] == keys[-1] and len(held) > 1:
                continue
            keys, fps = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield out(keys[:cut], fps[:cut])
            held = [(keys[cut:], fps[cut:])]
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    index = variants(fps).repartition("key").sortWithinPartitions("key", "fp")
    return index.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MAX_BITS,
) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Rows with equal fingerprints are one node. ``component_id`` is the smallest
    id reachable; null ids are smallest only where there is no other. Null and
    empty texts have the fingerprint zero. Repeated rows stay repeated.
    """
    if most != MAX_BITS:
        raise ValueError("three segments find links of up to four bits")
    rows = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = materialize(links(nodes.select("fp"), most), "links")
    roots = components(joined).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(nodes.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that with the smallest id, of equal ids the smallest key.

    The key of a row is its id with hashes of its text, so that texts which
    share an id are told apart. Null ids come last. Rows with equal ids and
    texts are copies, of which one stays, whatever their other columns hold.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    key = F.struct(
        F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(raw).alias("a"), F.hash(raw).alias("b"),
        F.octet_length(raw).alias("size"),
    )
    keyed = docs.withColumn("__key", key)
    kept = near_duplicates(keyed, "__key", text).select(F.col("component_id").alias("__key")).distinct()
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
