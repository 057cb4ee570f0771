"""Content and perceptual hashes.

The bit stages are plain column expressions over arrays; only decoded pixels need numpy (resizing, cosine transform).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import let, pack_bits

# Weights of blue, green and red in a gray level, in units of 2**-14.
GRAY = (1868, 9617, 4899)


def md5_hex(content: Column) -> Column:
    return F.md5(content)


def content_hash(content: Column) -> Column:
    """A 64-bit hash of the content, for cheap comparisons within a job; not a stable format."""
    return F.xxhash64(content)


def gradient_bits(grid: Column, side: int = 16) -> Column:
    """Bits of the difference hash of a (side + 1)**2 grid, row by row: each cell against its right neighbour along the
    rows, then each against the one below along the columns; 1 where the level rises. The last row and column only
    serve as neighbours."""
    n = side + 1
    at = lambda i: F.get(grid, i.cast("int"))
    steps = F.sequence(F.lit(0), F.lit(side * side - 1))

    def along_row(k: Column) -> Column:
        i = F.floor(k / side) * n + k % side
        return (at(i) < at(i + 1)).cast("int")

    def along_column(k: Column) -> Column:
        i = (k % side) * n + F.floor(k / side)
        return (at(i) < at(i + n)).cast("int")

    return F.concat(F.transform(steps, along_row), F.transform(steps, along_column))


def gradient_hash(grid: Column, side: int = 16) -> Column:
    """Hex text of gradient_bits; null for a grid of another size."""
    return F.when(F.size(grid) == (side + 1) ** 2, let(grid, lambda g: pack_bits(gradient_bits(g, side), 2 * side * side)))


def median_bits(values: Column, nbits: int) -> Column:
    """1 where a value exceeds the mean of the two middle values."""
    middle = lambda o: (F.get(o, F.lit(nbits // 2)).cast("double") + F.get(o, F.lit(nbits // 2 - 1)).cast("double")) / 2
    above = lambda m: F.transform(values, lambda v: (v.cast("double") > m).cast("int"))
    return let(F.array_sort(values), lambda o: let(middle(o), above))


def median_hash(values: Column, nbits: int = 256) -> Column:
    """Hex text of median_bits; null for another number of values."""
    return F.when(F.size(values) == nbits, let(values, lambda v: pack_bits(median_bits(v, nbits), nbits)))


@functools.lru_cache(maxsize=256)
def _area_weights(n: int, m: int) -> np.ndarray:
    """(m, n) shares of n source cells in m target cells of equal size."""
    edge = np.arange(m + 1) * (n / m)
    cells = np.arange(n)
    overlap = np.minimum(edge[1:, None], cells[None] + 1) - np.maximum(edge[:-1, None], cells[None])
    w = np.clip(overlap, 0, None)
    return w / w.sum(axis=1, keepdims=True)


def area_resize(gray: np.ndarray, size: int) -> np.ndarray:
    """Mean of the source area under each of size x size cells, as bytes. Enlarging repeats levels by the same rule."""
    h, w = gray.shape
    out = _area_weights(h, size) @ gray.astype(np.float64) @ _area_weights(w, size).T
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


@functools.lru_cache(maxsize=8)
def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    c = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    c[0] = np.sqrt(1 / n)
    return c.astype(np.float32)


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """Gray levels of (h, w, channels) bytes in the order blue, green, red."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    b, g, r = (pixels[:, :, i].astype(np.int64) * GRAY[i] for i in range(3))
    return ((b + g + r + (1 << 13)) >> 14).astype(np.uint8)


def dhash_of(gray: np.ndarray, side: int = 16) -> bytes:
    d = area_resize(gray, side + 1).astype(np.int16)
    rows = d[:side, :side] < d[:side, 1:]
    cols = (d[:side, :side] < d[1:, :side]).T
    return np.packbits(np.concatenate([rows.ravel(), cols.ravel()])).tobytes()


def phash_of(gray: np.ndarray, side: int = 16) -> bytes:
    n = side * 4
    x = area_resize(gray, n).astype(np.float32)
    low = (_cosines(n) @ x @ _cosines(n).T)[:side, :side].ravel()
    middle = np.sort(low)[len(low) // 2 - 1 : len(low) // 2 + 1]
    return np.packbits(low > np.float32((middle[0] + middle[1]) / np.float32(2))).tobytes()


def _image_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, p = [], []
        for h, w, c, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            if not data or h is None or h <= 0 or w <= 0:
                d.append(None)
                p.append(None)
                continue
            gray = to_gray(np.frombuffer(data, dtype=np.uint8).reshape(h, w, c))
            d.append(dhash_of(gray))
            p.append(phash_of(gray))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d, pa.binary()), pa.array(p, pa.binary())], names=["path", "v_dhash", "v_phash"])


def image_hashes(images: DataFrame) -> DataFrame:
    """``path, v_dhash, v_phash`` of decoded images: ``path, height, width, nChannels, data`` as Spark's image source
    gives them. Both hashes come from one look at the pixels; an image that could not be decoded has null hashes."""
    return images.select("path", "height", "width", "nChannels", "data").mapInArrow(_image_hashes, "path string, v_dhash binary, v_phash binary")
