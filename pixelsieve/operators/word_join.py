"""All pairs of bit strings within a Hamming distance, by groups of bits that nearly agree; exact.

Fewer than ``below`` differing bits leave some 64-bit word q with fewer than s_q of them, where the s_q add up to ``below``, and
some group k of that word's bits with fewer than s_qk, where the s_qk add up to s_q. So rows are sorted by each group, every value meets the
values that differ from it in so few bits, and their words are compared; what is left is compared as a whole. A pair counts at
the first group at which it is met. A task takes some of the groups for a pair of blocks; rows travel as packed bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .matrix_join import _cells, _sides

ROWS_A_BLOCK = 800_000
#: Bytes of hashes of a row that are shuffled, over all tasks that get it, while one block holds all rows.
COPIED_BYTES = 256
#: Pairs of words compared at once, in the processor's cache; rows of the other side gathered at once; pairs compared as a whole at once.
PAIRS, GATHERED, MET = 1 << 16, 1 << 19, 1 << 17
TILES = 64
#: Measured, in nanoseconds: a pair of words, a value with its own step, a gathered row, and a pair as a product of matrices for each bit.
PAIR_NS, TILE_NS, ROW_NS, BIT_NS = 1.8, 12_000, 8, 0.04


class Probe(NamedTuple):
    """Bits ``shift`` to ``shift + width`` of a word differ in at most ``flips``, the word in at most ``most``."""

    word: int
    shift: int
    width: int
    flips: int
    most: int

    @property
    def ball(self) -> int:
        return sum(math.comb(self.width, d) for d in range(self.flips + 1))

    def seconds(self, n_a: int, n_b: int) -> float:
        values = 1 << self.width
        return 1e-9 * (n_a * n_b * self.ball / values * PAIR_NS + min(values, n_a) * TILE_NS + n_b * self.ball * ROW_NS)


def _shares(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def probes(nbits: int, below: int, groups: int) -> list[Probe]:
    out = []
    for word, some in enumerate(_shares(below, nbits // 64)):
        shift = 64
        for width, share in zip(_shares(64, groups), _shares(some, groups)):
            shift -= width
            if share:
                out.append(Probe(word, shift, width, min(share - 1, width), some - 1))
    return out


def plan(nbits: int, below: int, n_a: int, n_b: int, always: bool = False) -> list[Probe]:
    """The cheapest probes for blocks of these sizes; none where products of matrices cost less, unless always, or where bits do not fill words."""
    if nbits % 64:
        return []
    a, b = (max(1, min(n, ROWS_A_BLOCK)) for n in (n_a, n_b))
    seconds, found = min(((sum(p.seconds(a, b) for p in x), x) for x in (probes(nbits, below, g) for g in range(4, 17))), key=lambda x: x[0])
    return found if always or seconds < 1e-9 * a * b * nbits * BIT_NS else []


def _spread(all_probes: list[Probe], parts: int, n_a: int, n_b: int) -> list[list[int]]:
    """The numbers of the probes of each part, for parts of about equal cost."""
    out: list[list[int]] = [[] for _ in range(parts)]
    cost = [0.0] * parts
    for k in sorted(range(len(all_probes)), key=lambda k: -all_probes[k].seconds(n_a, n_b)):
        least = cost.index(min(cost))
        out[least].append(k)
        cost[least] += all_probes[k].seconds(n_a, n_b)
    return out


def _sorted(words: np.ndarray, probe: Probe) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by value of the group, their words, and where each value begins."""
    keys = ((words >> np.uint64(probe.shift)) & np.uint64((1 << probe.width) - 1)).astype(np.uint16)
    order = np.argsort(keys, kind="stable")
    start = np.zeros((1 << probe.width) + 1, np.int64)
    np.cumsum(np.bincount(keys, minlength=1 << probe.width), out=start[1:])
    return order, words[order], start


class _Compared:
    """Words of both sides compared in the processor's cache, several blocks of rows and columns at once."""

    def __init__(self, words: np.ndarray, most: int):
        self.words, self.most = words, most
        self.differ, self.count, self.hit = np.empty(PAIRS, np.uint64), np.empty(PAIRS, np.uint8), np.empty(PAIRS, bool)
        self.used, self.blocks = 0, []

    def add(self, row: int, end: int, cols: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Compares the words of rows ``row`` to ``end`` with the columns, which are rows ``at`` of the other side."""
        for c in range(0, len(cols), PAIRS):
            right, there = cols[c : c + PAIRS], at[c : c + PAIRS]
            step = max(1, PAIRS // len(right))
            for r in range(row, end, step):
                left = self.words[r : min(r + step, end)]
                size = len(left) * len(right)
                if self.used + size > PAIRS:
                    yield from self.found()
                out = self.differ[self.used : self.used + size].reshape(len(left), len(right))
                np.bitwise_xor(left[:, None], right[None, :], out=out)
                self.blocks.append((self.used, r, len(right), there))
                self.used += size

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, row of the other side) of what is close among all since the last call."""
        full = (self.used + 7) // 8 * 8
        np.bitwise_count(self.differ[: self.used], out=self.count[: self.used])
        np.less_equal(self.count[: self.used], self.most, out=self.hit[: self.used])
        self.hit[self.used : full] = False
        some = np.flatnonzero(self.hit[:full].view(np.uint64))
        if len(some):
            bit = np.flatnonzero(self.hit[:full].reshape(-1, 8)[some])
            place = some[bit >> 3] * 8 + (bit & 7)
            of = np.searchsorted([x[0] for x in self.blocks], place, side="right") - 1
            for k in np.unique(of):
                begin, row, width, there = self.blocks[k]
                i, j = np.divmod(place[of == k] - begin, width)
                yield i + row, there[j]
        self.used, self.blocks = 0, []


def _near_words(a: np.ndarray, b: np.ndarray, probe: Probe, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words that agree as the probe says, of a and b as _sorted() has them; of two of one block once."""
    (_, words_a, start_a), (_, words_b, start_b) = a, b
    values = np.arange(1 << probe.width)
    masks = values[np.bitwise_count(values) <= probe.flips]
    compared = _Compared(words_a, probe.most)
    tiles = np.flatnonzero(np.diff(start_a))
    for t in range(0, len(tiles), TILES):
        tile = tiles[t : t + TILES]
        near = tile[:, None] ^ masks
        first = start_b[near]
        length = start_b[near + 1] - first
        if same:
            length[near < tile[:, None]] = 0
        total = [0, *np.cumsum(length.sum(axis=1)).tolist()]
        rows = list(zip(start_a[tile].tolist(), start_a[tile + 1].tolist()))
        k = 0
        while k < len(tile):
            upto = k + 1
            while upto < len(tile) and total[upto + 1] - total[k] <= GATHERED:
                upto += 1
            size = length[k:upto].ravel()
            at = np.repeat(first[k:upto].ravel() - np.cumsum(size) + size, size)
            at += np.arange(len(at))
            cols = words_b[at]
            for v in range(k, upto):
                s, e = total[v] - total[k], total[v + 1] - total[k]
                yield from compared.add(*rows[v], cols[s:e], at[s:e])
            k = upto
    yield from compared.found()


def _met(a: np.ndarray, b: np.ndarray, probe: Probe, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and b whose words agree as the probe says, many at once; of two rows of one block either order once."""
    left = _sorted(a, probe)
    right = left if same else _sorted(b, probe)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for i, j in _near_words(left, right, probe, same):
        if same:
            later = i < j
            i, j = i[later], j[later]
        held.append((left[0][i], right[0][j]))
        n += len(i)
        if n > MET:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _words(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(np.uint64)


@contextmanager
def _unbuffered() -> Iterator[None]:
    """numpy copies the operands of a table of rows and columns to its buffers, unless these are small."""
    before = np.setbufsize(16)
    try:
        yield
    finally:
        np.setbufsize(before)


@_unbuffered()
def _pairs(cells: pa.Table, width: int, below: int, all_probes: list[Probe], of_part: list[list[int]]) -> pa.Table:
    block, part = divmod(cells["q"][0].as_py(), len(of_part))
    same = cells["p"][0].as_py() == block
    (ia, a), (ib, b) = _sides(cells, width)
    del cells
    a, b = _words(a), _words(b)
    if same:
        ib, b = ia, a
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]
    for k in of_part[part]:
        word = all_probes[k].word
        one = np.ascontiguousarray(a[:, word])
        for i, j in _met(one, one if same else np.ascontiguousarray(b[:, word]), all_probes[k], same):
            differ = a[i] ^ b[j]
            apart = np.bitwise_count(differ)
            total = apart.sum(axis=1, dtype=np.int32)
            keep = (total < below) & (ia[i] != ib[j])
            i, j, differ, apart, total = i[keep], j[keep], differ[keep], apart[keep], total[keep]
            new = np.ones(len(i), bool)
            for p in all_probes[:k]:
                group = (differ[:, p.word] >> np.uint64(p.shift)) & np.uint64((1 << p.width) - 1)
                new &= (apart[:, p.word] > p.most) | (np.bitwise_count(group) > p.flips)
            x, y = ia[i[new]], ib[j[new]]
            out.append((np.maximum(x, y), np.minimum(x, y), total[new]))
    i, j, d = (np.concatenate(x) for x in zip(*out))
    return pa.table({"i": i, "j": j, "diff": d})


@_unbuffered()
def _near_any(cells: pa.Table, width: int, below: int, all_probes: list[Probe], of_part: list[list[int]]) -> pa.Table:
    part = cells["q"][0].as_py() % len(of_part)
    (ia, a), (_, b) = _sides(cells, width)
    del cells
    a, b = _words(a), _words(b)
    left = np.arange(len(a))
    for k in of_part[part]:
        probe = all_probes[k]
        gone = np.zeros(len(a), bool)
        for i, j in _met(a[left, probe.word], np.ascontiguousarray(b[:, probe.word]), probe, False):
            i = left[i]
            gone[i[np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int32) < below]] = True
        left = left[~gone[left]]  # rows that have met a partner need not be compared again
    met = np.ones(len(a), bool)
    met[left] = False
    return pa.table({"idx": np.unique(ia[met])})


def _parts(width: int, blocks: int, all_probes: list[Probe]) -> int:
    return max(1, min(len(all_probes), COPIED_BYTES // width, COPIED_BYTES // width // blocks))


def near_pairs(rows: DataFrame, column: str, nbits: int, below: int, n: int, all_probes: list[Probe]) -> DataFrame:
    """``i, j, diff``, i > j; n is about the number of rows, and the probes are those of plan()."""
    width, blocks = nbits // 8, max(1, math.ceil(n / ROWS_A_BLOCK))
    parts = _parts(width, blocks, all_probes)
    of_part = _spread(all_probes, parts, n // blocks, n // blocks)
    to = {b: [(max(b, o), min(b, o) * parts + k, int(b < o)) for o in range(blocks) for k in range(parts)] for b in range(blocks)}
    cells = _cells(rows, column, width, blocks, to)
    return cells.groupBy("p", "q").applyInArrow(lambda t: _pairs(t, width, below, all_probes, of_part), "i long, j long, diff int")


def matched(src: DataFrame, gallery: DataFrame, column: str, nbits: int, below: int, n_src: int, n_gallery: int, all_probes: list[Probe]) -> DataFrame:
    """``idx`` of the rows of src within the distance of some row of the gallery, each once."""
    width = nbits // 8
    p, q = (max(1, math.ceil(n / ROWS_A_BLOCK)) for n in (n_src, n_gallery))
    parts = _parts(width, max(p, q), all_probes)
    of_part = _spread(all_probes, parts, n_src // p, n_gallery // q)
    a = _cells(src, column, width, p, {b: [(b, o * parts + k, 0) for o in range(q) for k in range(parts)] for b in range(p)})
    b = _cells(gallery, column, width, q, {b: [(o, b * parts + k, 1) for o in range(p) for k in range(parts)] for b in range(q)})
    return a.union(b).groupBy("p", "q").applyInArrow(lambda t: _near_any(t, width, below, all_probes, of_part), "idx long").distinct()
