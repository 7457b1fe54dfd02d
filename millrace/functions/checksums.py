"""CRC-32C and XXH3-64 of binary columns, by Arrow batches.

A checksum runs along its bytes, but rows are independent: a batch's rows go side by side, a byte of each at a time, so
numpy's work is per byte position, not per byte.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASTAGNOLI = 0x82F63B78  # fixed value: the reflected polynomial
_SLICE = 1024  # byte positions of 4096 rows that are turned at a time


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1)
    return t


_TABLE = _table()


def crc32c_many(values: list[bytes], start: int = 0) -> np.ndarray:
    """CRC-32C of each value, continuing from `start`."""
    return crc32c_array(pa.array(values, pa.large_binary()), start)


def crc32c_array(values: pa.Array, start: int = 0) -> np.ndarray:
    """CRC-32C of each value of a binary array, read where it lies: beside the array a few MB are held, whatever its size."""
    wide = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    _, places, data = values.buffers()
    at = np.frombuffer(places, wide, count=len(values) + 1, offset=values.offset * wide().itemsize).astype(np.int64) if len(values) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.where(values.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    order = np.argsort(-size, kind="stable")
    out = np.full(len(values), start ^ 0xFFFFFFFF, np.uint32)
    for lane in range(0, len(order), 4096):
        rows = order[lane : lane + 4096]
        n, first = size[rows], at[:-1][rows]
        crc = out[rows]
        for lo in range(0, int(n[0]), _SLICE):  # a slice of the columns at a time
            live = int(np.searchsorted(-n, -lo, side="left"))
            wide = int(min(n[0] - lo, _SLICE))
            block = np.zeros((wide, live), np.uint8)
            for i, (begin, left) in enumerate(zip((first[:live] + lo).tolist(), np.minimum(n[:live] - lo, wide).tolist(), strict=True)):
                block[:left, i] = bytes_[begin : begin + left]
            for j in range(wide):
                k = int(np.searchsorted(-n[:live], -(lo + j), side="left"))
                crc[:k] = _TABLE[(crc[:k] ^ block[j, :k]) & np.uint32(255)] ^ (crc[:k] >> np.uint32(8))
        out[rows] = crc
    return out ^ np.uint32(0xFFFFFFFF)


@F.arrow_udf(T.LongType())
def crc32c(data: pa.Array) -> pa.Array:
    """Unsigned CRC-32C of BINARY; null for null."""
    return pa.array(crc32c_array(data).astype(np.int64), mask=data.is_null().to_numpy(zero_copy_only=False))


def _advance(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What checksums become after so many zero bytes: by squaring the matrix of one zero bit, a column per bit."""
    column = np.array([CASTAGNOLI, *(1 << k for k in range(31))], np.uint32)  # what each bit becomes
    bits, out = zeros.astype(np.int64) * 8, crc.copy()

    def times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        for k in range(32):
            y ^= np.where(x >> np.uint32(k) & np.uint32(1), matrix[k], np.uint32(0))
        return y

    while bits.any():
        out = np.where(bits & 1, times(column, out), out)
        bits, column = bits >> 1, times(column, column)
    return out


@F.pandas_udf(T.LongType())
def crc32c_shift(crc: pd.Series, after: pd.Series) -> pd.Series:
    """A block's part in the checksum of a sequence in which so many bytes come after it: the parts' xor is the whole's."""
    got = _advance(crc.to_numpy(np.int64).astype(np.uint32), after.to_numpy(np.int64))
    return pd.Series(got.astype("int64"), index=crc.index)


@F.pandas_udf(T.StringType())
def xxh3(data: pd.Series) -> pd.Series:
    """XXH3-64 with seed 0, as 16 hex digits (Spark has no unsigned type)."""
    import xxhash

    return data.map(lambda v: None if v is None else xxhash.xxh3_64_hexdigest(v))
