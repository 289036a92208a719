"""Vector expressions, and the two 16-bit float codecs as Arrow batch calls.

Sums over all elements belong into ``explode`` plus an aggregate, which stays
in generated code. The lambdas below are for arithmetic within one row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

# Types rather than type names: workers import this module without a context.
_CODES = T.ArrayType(T.IntegerType())
_FLOATS = T.ArrayType(T.FloatType())


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def squared_norm(a: Column | str) -> Column:
    return F.aggregate(
        a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )


def scale(a: Column | str, factor: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * factor)


def unit(a: Column | str) -> Column:
    return scale(a, 1.0 / F.sqrt(squared_norm(a)))


def to_matrix(array: pa.ListArray, dtype=np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(array), -1)


def from_matrix(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), kind))


def _first(x: np.ndarray) -> np.ndarray:
    return x[:, 0]


def _total(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=1)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


# First value, sum and squared norm of each row of a matrix of doubles.
PARTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"first": _first, "total": _total, "sq": _squares}


@F.arrow_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in PARTS]))
def vector_parts(array: pa.Array) -> pa.Array:
    """``PARTS`` of each vector; all have one width."""
    lengths = pc.fill_null(pc.list_value_length(array), -1).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != max(lengths[0], 1)).any():
        raise ValueError("a vector is missing or has another width")
    x = to_matrix(array) if len(array) else np.empty((0, 1))
    return pa.StructArray.from_arrays([pa.array(make(x), pa.float64()) for make in PARTS.values()], list(PARTS))


def _per_element(
    array: pa.ListArray, fn: Callable[[pa.Array], np.ndarray], kind: pa.DataType
) -> pa.ListArray:
    lengths = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    mask = array.is_null() if array.null_count else None
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(fn(array.flatten()), kind), mask=mask
    )


def _bf16_codes(values: pa.Array) -> np.ndarray:
    x = values.to_numpy(zero_copy_only=False).astype(np.float32)
    bits = x.view(np.uint32).astype(np.uint64)
    codes = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16  # round to nearest even
    return np.where(np.isnan(x), 0x7FC0, codes).astype(np.int32)


def _bf16_values(codes: pa.Array) -> np.ndarray:
    bits = codes.to_numpy(zero_copy_only=False).astype(np.uint32) << 16
    return bits.view(np.float32)


def _f16_codes(values: pa.Array) -> np.ndarray:
    x = values.to_numpy(zero_copy_only=False).astype(np.float16)
    return x.view(np.uint16).astype(np.int32)


def _f16_values(codes: pa.Array) -> np.ndarray:
    bits = codes.to_numpy(zero_copy_only=False).astype(np.uint16)
    return bits.view(np.float16).astype(np.float32)


@F.arrow_udf(_CODES)
def bf16_codes(array: pa.Array) -> pa.Array:
    return _per_element(array, _bf16_codes, pa.int32())


@F.arrow_udf(_FLOATS)
def bf16_values(array: pa.Array) -> pa.Array:
    return _per_element(array, _bf16_values, pa.float32())


@F.arrow_udf(_CODES)
def f16_codes(array: pa.Array) -> pa.Array:
    return _per_element(array, _f16_codes, pa.int32())


@F.arrow_udf(_FLOATS)
def f16_values(array: pa.Array) -> pa.Array:
    return _per_element(array, _f16_values, pa.float32())


@F.arrow_udf(_FLOATS)
def f32_bytes_to_floats(array: pa.Array) -> pa.Array:
    """Vectors from the bytes of their floats, without a copy of them."""
    array = array.cast(pa.binary())
    at = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)
    if (at % 4 != at[0] % 4).any():
        raise ValueError("these are no floats")
    cells = np.frombuffer(array.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view("<f4")
    ends = pa.array((at - at[0]) // 4, pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(cells, pa.float32()), mask=array.is_null() if array.null_count else None)


@F.arrow_udf(_FLOATS)
def f16_bytes_to_floats(array: pa.Array) -> pa.Array:
    def decode(cells: pa.Array) -> np.ndarray:
        raw = b"".join(cells.to_pylist())
        return np.frombuffer(raw, dtype="<f2").astype(np.float32)

    return _per_element(array, decode, pa.float32())
