"""All pairs of bit strings within a Hamming distance, block against block, as products of matrices of -1 and 1.

A product of n-bit rows is n - 2 * distance, exact in single precision, so a processor's matrix unit compares more
than 100 million pairs a second and core. Each side is cut into blocks; a pair of blocks meets in one task, rows
travel as packed bytes, and nothing is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_BLOCK = 50_000
LEAST_BLOCKS = 6
CHUNK_A, CHUNK_B = 1024, 4096
_CELLS = "p int, q int, side int, ids binary, bits binary"


def _signs(rows: np.ndarray) -> np.ndarray:
    out = np.unpackbits(rows, axis=1).astype(np.float32)
    out *= 2
    out -= 1
    return out


def _pack(batches: Iterator[pa.RecordBatch], width: int, pairs_of: dict[int, list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
    """pairs_of: for each block of this side the (p, q, side) to which it goes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, width)
        cells = []
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            data = (ids[at].astype(np.int64).tobytes(), bits[at].tobytes())
            cells += [(*to, *data) for to in pairs_of[int(b)]]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), types)], names=["p", "q", "side", "ids", "bits"])


def _sides(cells: pa.Table, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    side = cells["side"].to_numpy()
    ids, bits = cells["ids"].to_pylist(), cells["bits"].to_pylist()
    return [(np.frombuffer(b"".join(ids[i] for i in np.flatnonzero(side == s)), np.int64), np.frombuffer(b"".join(bits[i] for i in np.flatnonzero(side == s)), np.uint8).reshape(-1, width)) for s in (0, 1)]


def _blocks(a: np.ndarray, b: np.ndarray, below: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, distance) of all pairs below the distance, chunk by chunk."""
    n = a.shape[1] * 8
    for s in range(0, len(b), CHUNK_B):
        right = _signs(b[s : s + CHUNK_B]).T.copy()
        for t in range(0, len(a), CHUNK_A):
            dot = _signs(a[t : t + CHUNK_A]) @ right
            i, j = np.nonzero(dot > n - 2 * below)
            yield i + t, j + s, ((n - dot[i, j]) / 2).astype(np.int32)


def _near(cells: pa.Table, width: int, below: int) -> pa.Table:
    (ia, a), (ib, b) = _sides(cells, width)
    same = cells["p"][0] == cells["q"][0]
    if same:
        ib, b = ia, a
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]
    for i, j, d in _blocks(a, b, below):
        x, y = ia[i], ib[j]
        keep = x > y if same else x != y
        out.append((np.maximum(x, y)[keep], np.minimum(x, y)[keep], d[keep]))
    i, j, d = (np.concatenate(x) for x in zip(*out))
    return pa.table({"i": i, "j": j, "diff": d})


def _met(cells: pa.Table, width: int, below: int) -> pa.Table:
    (ia, a), (_, b) = _sides(cells, width)
    left = np.arange(len(a))
    for s in range(0, len(b), CHUNK_B):  # rows that have met a partner need not be compared again
        gone = np.zeros(len(a), dtype=bool)
        for i, _, _ in _blocks(a[left], b[s : s + CHUNK_B], below):
            gone[left[i]] = True
        left = left[~gone[left]]
    met = np.ones(len(a), dtype=bool)
    met[left] = False
    return pa.table({"idx": np.unique(ia[met])})


def _cells(rows: DataFrame, column: str, width: int, blocks: int, pairs_of: dict) -> DataFrame:
    valid = rows.filter((F.length(column) == width) & F.col("idx").isNotNull())
    with_block = valid.select(F.col("idx").cast("long"), F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int").alias("block"), column)
    return with_block.mapInArrow(lambda x: _pack(x, width, pairs_of), _CELLS)


def near_pairs(rows: DataFrame, column: str, nbits: int, below: int, n: int) -> DataFrame:
    """``i, j, diff``, i > j; n is about the number of rows."""
    blocks = max(LEAST_BLOCKS, math.ceil(n / ROWS_A_BLOCK))
    pairs_of = {b: [(max(b, o), min(b, o), int(b < o)) for o in range(blocks)] for b in range(blocks)}
    width = nbits // 8
    return _cells(rows, column, width, blocks, pairs_of).groupBy("p", "q").applyInArrow(lambda t: _near(t, width, below), "i long, j long, diff int")


def matched(src: DataFrame, gallery: DataFrame, column: str, nbits: int, below: int, n_src: int, n_gallery: int) -> DataFrame:
    """``idx`` of the rows of src within the distance of some row of the gallery, each once."""
    width = nbits // 8
    p, q = max(LEAST_BLOCKS, math.ceil(n_src / ROWS_A_BLOCK)), max(1, math.ceil(n_gallery / ROWS_A_BLOCK))
    a = _cells(src, column, width, p, {b: [(b, o, 0) for o in range(q)] for b in range(p)})
    b = _cells(gallery, column, width, q, {b: [(o, b, 1) for o in range(p)] for b in range(q)})
    return a.union(b).groupBy("p", "q").applyInArrow(lambda t: _met(t, width, below), "idx long").distinct()
