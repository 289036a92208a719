"""Words of whole Arrow text columns, as codes into the distinct words of the column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 4 << 20


def _table(space: bytes, lower: bool) -> bytes:
    table = bytearray(range(256))
    if lower:
        table[65:91] = range(97, 123)
    for byte in space:
        table[byte] = 32
    return bytes(table)


WHITE = b" \t\n\x0b\x0c\r"
NOT_ALNUM = bytes(i for i in range(128) if not chr(i).isalnum())
#: byte maps: white space to one blank; the same in lower case; all that is no word of letters or digits to a blank
KEEP_CASE = _table(WHITE, lower=False)
LOWER = _table(WHITE, lower=True)
LOWER_ALNUM = _table(NOT_ALNUM, lower=True)


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes each; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        share = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(share)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def coded(texts: pa.Array, table: bytes = KEEP_CASE) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words in order, the offsets of each text in them, and the distinct words.

    Null and empty texts have no words.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts.slice(0, 0), texts])
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = (b"" if data is None else data.to_pybytes()[ends[0] : ends[-1]]).translate(table)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(raw))
    parts = pc.split_pattern(plain, " ")
    flat = parts.values
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])
    offsets = before[parts.offsets.to_numpy()]
    found = flat.filter(pa.array(full)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int32), offsets, found.dictionary


def hashed(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task.

    Words are mixed eight bytes at a time, all words at once; the few over
    ``_LONG`` bytes are hashed one by one.
    """
    raw = words.cast(pa.large_binary())
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = raw.buffers()[2]
    text = (b"" if data is None else memoryview(data)[ends[0] : ends[-1]].tobytes()) + bytes(8)
    lanes = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    starts, size = ends[:-1] - ends[0], np.diff(ends)
    out = mixed(size.astype(np.uint64) * _BASE + np.uint64(seed))
    at = np.flatnonzero(size <= _LONG)
    for step in range(0, _LONG, 8):
        at = at[size[at] > step]
        if not len(at):
            break
        room = np.minimum(size[at] - step, 8).astype(np.uint64)
        lane = lanes[starts[at] + step] & (_FULL >> (np.uint64(64) - np.uint64(8) * room))
        out[at] = mixed(out[at] * _BASE + lane)
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : starts[i] + size[i]], seed)
    return out


_LONG = 64
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` consecutive entries, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += h[j : j + n]
    return mixed(out)
