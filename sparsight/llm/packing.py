"""Token packing: first-fit decreasing on a tournament tree, in randomised groups of documents.

Documents are tokenised once. Each falls into a group at random; a group packs
alone. Whole sequences are cut off long documents, the rest is placed first-fit
decreasing; the least filled sequences are then cut up to fill the gaps of the
others, so that a group pads one sequence at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F

LENGTH = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: documents of a group on average, or fewer where their texts are long: the ids of so many bytes of text are held by one task
GROUP_DOCUMENTS, GROUP_BYTES = 4096, 64 << 20
_PIECE_BYTES = 8 << 20


class TournamentTree:
    """The room left in each bin, with the first bin that has enough found from the top."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1
        while self.size < max(1, bins):
            self.size *= 2
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """Put ``length`` into the first bin with room; its number, or -1 if none has."""
        room, i = self.room, 1
        if room[1] < length:
            return -1
        while i < self.size:
            i *= 2
            if room[i] < length:
                i += 1
        room[i] -= length
        bin_, i = i - self.size, i // 2
        while i:
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
            i //= 2
        return bin_


def plan(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """``item, start, size, sequence, offset`` of every piece, by sequence and offset.

    No sequence holds more than ``length``; at most one is not full. Items of
    length zero have no piece.
    """
    pieces: list[list[tuple[int, int, int]]] = []
    rest = []
    for item, n in enumerate(lengths.tolist()):
        for start in range(0, n - length + 1, length):
            pieces.append([(item, start, length)])
        if n % length:
            rest.append((n % length, item, n - n % length))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = TournamentTree(len(rest), length), []
    for n, item, start in rest:
        at = tree.place(n)
        if at >= len(bins):
            bins.append([])
        bins[at].append((item, start, n))
    filled = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (filled[i], i))
    gaps = [i for i in reversed(order) if filled[i] < length]
    dissolved = 0
    for i in order:  # from the least filled on, while the gaps of the others hold it
        if not gaps or i == gaps[0] or sum(length - filled[j] for j in gaps if j != i) < filled[i]:
            break
        gaps.remove(i)
        for item, start, n in sorted(bins[i], key=lambda p: -p[2]):
            while n:
                j = gaps[0]
                take = min(n, length - filled[j])
                bins[j].append((item, start, take))
                filled[j] += take
                start, n = start + take, n - take
                if filled[j] == length:
                    gaps.pop(0)
        bins[i] = []
        dissolved += 1
    if len(gaps) > 1:  # what is left in the last one goes as far as the other gaps reach
        last = gaps.pop()
        moved = []
        for item, start, n in bins[last]:
            while n and gaps:
                j = gaps[0]
                take = min(n, length - filled[j])
                bins[j].append((item, start, take))
                filled[j] += take
                start, n = start + take, n - take
                if filled[j] == length:
                    gaps.pop(0)
            if n:
                moved.append((item, start, n))
        bins[last] = moved
    pieces += [b for b in bins if b]
    flat = np.array([p for b in pieces for p in b], np.int64).reshape(-1, 3)
    count = np.array([len(b) for b in pieces], np.int64)
    sequence = np.repeat(np.arange(len(pieces)), count)
    before = np.cumsum(flat[:, 2]) - flat[:, 2]
    offset = before - before[np.repeat(np.cumsum(count) - count, count)] if len(flat) else before
    return flat[:, 0], flat[:, 1], flat[:, 2], sequence, offset


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` file, its added tokens as special ones.

    Its vocabulary lists every merge by id, so the ids are the ranks; byte
    values are written as printable characters in the way of that file format.
    """
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    special = {x["content"]: x["id"] for x in given["added_tokens"]}
    if any(x[k] for x in given["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens must stand for their own characters alone")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(letters[c] for c in t): i for t, i in given["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def _blank_first(path: str) -> np.ndarray:
    """Which ids start with a blank."""
    code = encoder(path)
    return np.array([code.decode_single_token_bytes(i).startswith(b" ") for i in range(code.max_token_value + 1)])


def encode(texts: pa.Array, path: str, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and where each text's begin and end.

    A blank between two characters that are no white space always starts a new
    token, so such texts are cut there and each distinct part is encoded once;
    texts with longer white space are encoded whole. With ``added``, added
    tokens of the file that stand in a text become their ids, as ``tokenizers``
    has it by default; without, they are ordinary text.
    """
    bpe = encoder(path)
    code = (lambda t: bpe.encode(t, allowed_special="all")) if added else bpe.encode_ordinary
    texts = pc.fill_null(texts.cast(pa.string()), "")
    whole = pc.match_substring_regex(texts, r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]{2}").to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts, " ")
    bounds, flat = parts.offsets.to_numpy(), parts.values
    first = np.zeros(len(flat), bool)
    first[bounds[:-1]] = True
    mixed = bool(whole.any())
    ours = np.repeat(~whole, np.diff(bounds)) if mixed else np.ones(len(flat), bool)
    # the part after a blank keeps it
    head = flat.filter(pa.array(first & ours)).dictionary_encode()
    tail = (flat.filter(pa.array(ours)) if mixed else flat).dictionary_encode()
    known = [code(w) for w in [*head.dictionary.to_pylist(), *texts.filter(pa.array(whole)).to_pylist()]]
    n_head, shift = len(head.dictionary), len(known)
    joined = np.empty(0, np.int64)
    if len(tail.dictionary):
        # no part holds a blank: in one long text of them, ids that start with one start a part
        line = pc.binary_join(pa.ListArray.from_arrays([0, len(tail.dictionary)], tail.dictionary), " ")[0].as_py()
        joined = np.array(code(" " + line), np.int64)
    heads = np.flatnonzero(_blank_first(path)[joined])
    number = np.full(len(flat), -1, np.int64)
    number[ours] = tail.indices.to_numpy(zero_copy_only=False)
    number[ours] += shift
    number[first & ours] = head.indices.to_numpy(zero_copy_only=False)
    number[bounds[:-1][whole]] = np.arange(whole.sum()) + n_head
    size = np.concatenate([np.array([0, *map(len, known)], np.int64)[1:], np.diff(np.append(heads, len(joined)))])
    values = np.concatenate([np.array([i for ids in known for i in ids], np.int64), joined])
    starts = np.cumsum(size) - size
    n = np.where(number < 0, 0, size[number] if len(size) else 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(starts[number] if len(size) else n, n)
    return values[at], ends[bounds]


def _width(path: str, end_id: int) -> np.dtype:
    return np.dtype("<u2" if max(encoder(path).max_token_value, end_id) < 1 << 16 else "<u4")


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids``: the ids of every text and ``end_id``, as little-endian bytes."""
    from sparsight.llm.words import bounded

    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(path, end_id)
        for batch in bounded(batches, "t", _PIECE_BYTES):
            ids, ends = encode(batch.column("t"), path, added=True)
            out = np.insert(ids, ends[1:], end_id).astype(width)
            bounds = (ends + np.arange(len(ends))) * width.itemsize
            raw = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())]
            )
            yield pa.RecordBatch.from_arrays([batch.column("i"), raw], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, ids binary")


def _within(ends: np.ndarray) -> np.ndarray:
    """Ends of values in one Arrow buffer, which has 32 bits for them."""
    if ends[-1] >= 1 << 31:
        raise ValueError("a text of over 500 million tokens does not fit one buffer")
    return ends


def packed(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
    end_id: int = END_ID, group_documents: int = GROUP_DOCUMENTS,
) -> DataFrame:
    """``doc_id, start, ids, doc_tokens, sequence_id, offset`` of every piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.

    Null and empty texts give the end id alone. Repeated rows are packed each
    for itself: the group is drawn by row, so that no id or text can fill one.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    groups = 1 + max(n // group_documents, (size or 0) // GROUP_BYTES)
    tokens = tokenized(docs, path, doc_id, text, end_id).withColumn(
        "g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    )

    def pack(group: pa.Table) -> pa.Table:
        width = _width(path, end_id)
        ids = group.column("ids").combine_chunks()
        size = pc.binary_length(ids).to_numpy() // width.itemsize
        item, start, n, sequence, offset = plan(size, length)
        values = np.frombuffer(b"".join(ids.to_pylist()), width)
        base = (np.cumsum(size) - size)[item] + start
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(base - ends[:-1], n) + np.arange(ends[-1])
        number = group.column("g")[0].as_py()
        return pa.table({
            "doc_id": group.column("doc_id").combine_chunks().take(pa.array(item)),
            "start": pa.array(start),
            "ids": pa.Array.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer(_within(4 * ends).astype(np.int32).tobytes()), pa.py_buffer(values[at].astype("<u4").tobytes())]
            ),
            "doc_tokens": pa.array(size[item].astype(np.int64)),
            "sequence_id": pa.array((np.int64(number) << 32) + sequence),
            "offset": pa.array(offset),
        })

    return tokens.groupBy("g").applyInArrow(
        pack, f"doc_id {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ``length`` and ``ids_crc32``, the CRC-32 of the bytes of their ids, in place of the ids."""
    return pieces.withColumns(
        {"length": (F.octet_length("ids") / 4).cast("bigint"), "ids_crc32": F.crc32("ids")}
    ).drop("ids")
