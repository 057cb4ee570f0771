"""Helpers shared by the operators of this subpackage.

Several operators move many small fixed-width records through one shuffle and work on them with numpy. They pack
the records of an Arrow batch into a few binary cells per target bucket, so that Spark moves dense bytes instead of
one row per record; a bucket's size is bounded by the number of buckets, which follows the number of records.
"""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpointed, forget, shared_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """(n, width) bytes of a binary column without nulls whose values all have this width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def words64(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(np.uint64)


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as base + 32-bit offsets where the range allows it, else as 64 bits each."""
    values = np.asarray(values, dtype=np.int64)
    if not len(values):
        return b""
    low, high = int(values.min()), int(values.max())
    if high - low < 2**32:
        return struct.pack("<bq", 4, low) + (values - low).astype(np.uint32).tobytes()
    return struct.pack("<bq", 8, 0) + values.tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=np.int64)
    width, low = struct.unpack_from("<bq", data)
    body = np.frombuffer(data, dtype=np.uint32 if width == 4 else np.int64, offset=9)
    return body.astype(np.int64) + low


def joined_ints(cells: Iterable[bytes]) -> np.ndarray:
    parts = [unpack_ints(x) for x in cells]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def joined(cells: Iterable[bytes], dtype: type | np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=dtype)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its members) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, dtype=int)
    for s, e in zip(cut, np.r_[cut[1:], len(b)].astype(int) if len(cut) else []):
        yield int(b[s]), order[s:e]


def run_starts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_keys):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    s = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return s, np.diff(np.r_[s, len(sorted_keys)])


#: Multiplier of the polynomial hashes modulo 2**64; odd, so that it has an inverse there.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, x, dtype=np.uint64)]) for x in (BASE, BASE_INVERSE))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to at least size."""
    return _powers(1 << max(12, math.ceil(math.log2(size + 1))))


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes so that any of their bits can choose a bucket."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Text:
    """Code points of one or more strings laid end to end, with hashes of any window in constant time."""

    def __init__(self, strings: list[str]):
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.r_[np.int64(0), np.cumsum(self.lengths)]
        self.points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        up, self.down = powers(len(self.points) + 1)
        self.prefix = np.r_[np.uint64(0), np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * up[: len(self.points)])]

    def windows(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the windows at these positions of the joined strings."""
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]
