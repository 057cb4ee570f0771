"""Most similar vectors for every query vector (problem 1).

Bits are vectors of 0 and 1, whose squared distance is the number of differing bits. They are rotated by a random
permutation of their columns, the orthogonal matrix that leaves bits bits: of two vectors, any first columns are then a
random draw of all, so that the distance over them is an unbiased estimate of the whole with a known (hypergeometric)
distribution.

Rows are kept in lists: in each of TABLES tables a row's list is its value at k of its columns, k growing with the logarithm
of the rows so that lists stay short. A query probes the lists whose value differs from its own in at most ``flips``
columns, nearest lists first; ``plan_lists`` chooses flips so that a neighbour at the share FAR of differing bits is met with
a chance of at least RECALL, whatever the number of rows. Every row of a probed list is scanned in blocks of 64 columns: after each block
a hypothesis test of level ALPHA abandons the candidates whose distance so far would be too large for one within the query's
present k-th best. What is left is measured to the end, so reported distances are exact. No candidate is compared in another way.
The search goes in two rounds: the lists less than ``flips`` columns away give each query a bound over all tables, with which
the lists at ``flips`` columns, most of the work, are scanned.

A cell of work is the lists of one table with the same first columns (a part). Queries are sent to the parts that they
probe. Parts with more than ROWS_A_CELL rows, counted beforehand, are split by a hash of the id, so that hot
lists are no larger than others; of equal rows in one batch only the k + 1 smallest ids, all that can be an answer, are sent.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, checkpointed, fixed, joined, joined_ints, mix64, pack_ints, words64
from .segments import expand

TABLES = 4
#: A neighbour that differs in the share FAR of its bits is met in some probed list with a chance of RECALL.
FAR, RECALL = 0.2, 0.97
#: So many rows are looked at for a query where that is more than it takes for RECALL.
ROWS_A_QUERY = 25_000
#: Rows a list has on average, and rows a cell has at most.
ROWS_A_LIST = 8
ROWS_A_CELL = 1_000_000
#: Chance with which a test abandons a candidate exactly at the bound; smaller for nearer ones.
ALPHA = 0.0001
#: Candidates that may wait before they are cut to the k nearest of each query; pairs looked at in one step.
WAITING, AT_ONCE = 4_000_000, 1 << 20
SEED = 20_011


class Plan(NamedTuple):
    """k columns tell a row's list, the first ``parts`` of them its part; a query probes lists up to ``flips`` columns away,
    at most ``part_flips`` of them in the part."""

    tables: int
    k: int
    parts: int
    flips: int
    part_flips: int


def _binomial(n: int, i: int, p: float) -> float:
    return math.comb(n, i) * p**i * (1 - p) ** (n - i)


def meets(k: int, parts: int, flips: int, part_flips: int, share: float) -> float:
    """Chance that rows differing in this share of their bits meet in a probed list of one table."""
    within = lambda n, most: sum(_binomial(n, i, share) for i in range(min(n, most) + 1))
    return sum(_binomial(parts, i, share) * within(k - parts, flips - i) for i in range(min(parts, part_flips, flips) + 1))


def plan_lists(n: int, nbits: int) -> Plan:
    parts = max(2, math.ceil(math.log2(max(1, n / ROWS_A_CELL))))
    k = min(nbits // 2, 60, max(parts, round(math.log2(max(1, n / ROWS_A_LIST)))))
    chance = lambda flips, part_flips: 1 - (1 - meets(k, parts, flips, part_flips, FAR)) ** TABLES
    part_flips = next(g for g in range(parts + 1) if g == parts or chance(k, g) >= (1 + RECALL) / 2)
    flips = next(f for f in range(k + 1) if f == k or chance(f, part_flips) >= RECALL)
    # short tables can afford more lists; of unrelated rows half the bits differ
    flips = max(flips, max((f for f in range(k + 1) if TABLES * n * meets(k, parts, f, part_flips, 0.5) <= ROWS_A_QUERY), default=0))
    return Plan(TABLES, k, parts, flips, parts if flips == k else part_flips)


@functools.lru_cache(maxsize=4)
def _columns(nbits: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The permutation, and the columns of each table's values."""
    rng = np.random.default_rng(SEED)
    turn = rng.permutation(nbits)
    return turn, np.stack([rng.choice(nbits, plan.k, replace=False) for _ in range(plan.tables)])


@functools.lru_cache(maxsize=4)
def _limits(nbits: int, alpha: float) -> np.ndarray:
    """[block, bound]: the largest distance after the block at which a candidate is not abandoned."""
    log = np.r_[0.0, np.cumsum(np.log(np.arange(1, nbits + 1)))]
    choose = lambda n, k: log[n] - log[k] - log[n - k]
    blocks = nbits // 64
    out = np.zeros((blocks, nbits + 2), dtype=np.int16)
    for b in range(blocks):
        c = 64 * (b + 1)
        for r in range(nbits + 1):
            x = np.arange(max(0, c - (nbits - r)), min(r, c) + 1)
            tail = np.cumsum(np.exp(choose(np.full(len(x), r), x) + choose(np.full(len(x), nbits - r), c - x) - choose(nbits, c))[::-1])[::-1]
            more = np.flatnonzero(tail[1:] <= alpha)  # of a distance above x
            out[b, r] = x[more[0]] if alpha > 0 and len(more) else x[-1]
        out[b, nbits + 1] = c
    return out


def _rotated(rows: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return np.packbits(np.unpackbits(rows, axis=1)[:, turn], axis=1)


def _values(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    v = np.zeros(len(rows), dtype=np.int64)
    for p in at.tolist():
        v = (v << 1) | ((rows[:, p >> 3] >> np.uint8(7 - (p & 7))) & np.uint8(1))
    return v


def _split(ids: np.ndarray, splits: np.ndarray) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % splits.astype(np.uint64)).astype(np.int64)


def _few_equal(ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Positions of the rows, of equal ones only those of the ``most`` smallest ids."""
    words = words64(rows)
    h = np.zeros(len(rows), dtype=np.uint64)
    for i in range(words.shape[1]):
        h = mix64(h ^ words[:, i])
    order = np.lexsort((ids, h))
    same = np.r_[False, (words[order[1:]] == words[order[:-1]]).all(axis=1)]
    if not same.any():
        return np.arange(len(rows))
    start = np.flatnonzero(~same)
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    return order[rank < most]


_COUNTS = "part int, n long"


def _count(batches: Iterator[pa.RecordBatch], width: int, plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows of each part of each table."""
    turn, columns = _columns(width * 8, plan)
    for batch in batches:
        if batch.num_rows:
            rows = _rotated(fixed(batch.column(1), width), turn)
            part = np.concatenate([(t << plan.parts) + _values(rows, at[: plan.parts]) for t, at in enumerate(columns)])
            which, n = np.unique(part, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(n)], names=["part", "n"])


_CELLS = "cell int, ids binary, bits binary"
_TYPES = (pa.int32(), pa.binary(), pa.binary())


def _pack_rows(batches: Iterator[pa.RecordBatch], width: int, plan: Plan, splits: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    turn, columns = _columns(width * 8, plan)
    first = np.cumsum(splits) - splits
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, rows = batch.column(0).to_numpy(), fixed(batch.column(1), width)
        few = _few_equal(ids, rows, most)
        ids, rows = ids[few], _rotated(rows[few], turn)
        cells = []
        for t, at in enumerate(columns):
            part = (t << plan.parts) + _values(rows, at[: plan.parts])
            cells += [(c, pack_ints(ids[p]), rows[p].tobytes()) for c, p in by_bucket(first[part] + _split(ids, splits[part]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), _TYPES)], names=["cell", "ids", "bits"])


@functools.lru_cache(maxsize=64)
def _masks(width: int, ones: int) -> np.ndarray:
    """Numbers of so many bits of which so many are set."""
    return np.array([sum(1 << i for i in c) for c in itertools.combinations(range(width), ones)], dtype=np.int64)


_ASKED = "cell int, ids binary, bounds binary, bits binary"


def _pack_queries(batches: Iterator[pa.RecordBatch], width: int, plan: Plan, splits: np.ndarray) -> Iterator[pa.RecordBatch]:
    turn, columns = _columns(width * 8, plan)
    first = np.cumsum(splits) - splits
    masks = np.concatenate([_masks(plan.parts, i) for i in range(plan.part_flips + 1)])
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, rows, bounds = batch.column(0).to_numpy(), _rotated(fixed(batch.column(1), width), turn), batch.column(2).to_numpy()
        cells = []
        for t, at in enumerate(columns):
            for own, p in by_bucket(_values(rows, at[: plan.parts])):
                packed = pack_ints(ids[p]), bounds[p].astype(np.uint16).tobytes(), rows[p].tobytes()
                for part in ((t << plan.parts) + (own ^ masks)).tolist():
                    cells += [(int(first[part]) + s, *packed) for s in range(splits[part])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), (*_TYPES, pa.binary()))], names=["cell", "ids", "bounds", "bits"])


class _Best:
    """The k nearest so far of each query, by distance and then id."""

    def __init__(self, bound: np.ndarray, k: int):
        self.k, self.bound, self.new, self.waiting = k, bound, [], 0
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def add(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        if len(q):
            self.new.append((q, d, ids))
            self.waiting += len(q)
            if self.waiting > WAITING:
                self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        q, d, ids = (np.concatenate([x, *y]) for x, y in zip(self.found, zip(*self.new)))
        self.new, self.waiting = [], 0
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        first = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]  # equal ids have equal distances, so they are neighbours
        q, d, ids = q[first], d[first], ids[first]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = rank < self.k
        last = rank == self.k - 1
        self.bound[q[last]] = np.minimum(self.bound[q[last]], d[last])
        self.found = (q[keep], d[keep], ids[keep])


class _Lists:
    """The lists of one cell, and queries that scan them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, low: np.ndarray, low_bits: int, alpha: float):
        order = np.argsort(low, kind="stable")
        self.words = np.ascontiguousarray(words64(rows[order]).T)
        self.ids = ids[order]
        self.start = np.searchsorted(low[order], np.arange((1 << low_bits) + 1))
        self.low_bits, self.limits = low_bits, _limits(rows.shape[1] * 8, alpha)
        #: Pairs looked at, and of them those not abandoned after each block.
        self.work = np.zeros(len(self.words) + 1, dtype=np.int64)

    def scan(self, best: _Best, words: np.ndarray, qid: np.ndarray, q: np.ndarray, r: np.ndarray, d: np.ndarray | None = None, block: int = 0) -> None:
        """Pairs (q, r), block by block; d is their distance over the blocks before ``block``."""
        d = np.zeros(len(q), dtype=np.int16) if d is None else d
        self.work[0] += len(q) if not block else 0
        limit = self.limits[:, best.bound]
        for b in range(block, len(self.words)):
            d = d + np.bitwise_count(words[b][q] ^ self.words[b][r])
            left = np.flatnonzero(d <= limit[b][q])
            self.work[b + 1] += len(left)
            q, r, d = q[left], r[left], d[left]
        other = np.flatnonzero(qid[q] != self.ids[r])
        best.add(q[other], d[other].astype(np.int64), self.ids[r[other]])

    def probe(self, best: _Best, words: np.ndarray, qid: np.ndarray, q: np.ndarray, low: np.ndarray, flips: int) -> None:
        """The lists so many columns away from the values ``low`` of the queries q."""
        masks = _masks(self.low_bits, flips)
        for s in range(0, len(q), step := max(1, AT_ONCE // max(1, len(masks)))):
            some = q[s : s + step]
            lists = (low[some][:, None] ^ masks[None]).ravel()
            lo, hi = self.start[lists], self.start[lists + 1]
            has = np.flatnonzero(hi > lo)
            for i, r in expand(some[has // len(masks)], lo[has], hi[has], AT_ONCE):
                self.scan(best, words, qid, i, r)

    def all(self, best: _Best, words: np.ndarray, qid: np.ndarray) -> None:
        """All rows as one list, for every query: whole blocks side by side while few pairs are abandoned."""
        n, s, step = len(self.ids), 0, 256
        while s < n:
            e = min(n, s + step)
            for t in range(0, len(qid), 32):  # few enough that a tile stays in the cache
                q, limit = np.arange(t, min(len(qid), t + 32)), self.limits[:, best.bound[t : t + 32]]
                d = np.zeros((len(q), e - s), dtype=np.int16)
                self.work[0] += d.size
                for b in range(len(self.words)):
                    d += np.bitwise_count(words[b][q][:, None] ^ self.words[b][s:e][None])
                    left = d <= limit[b][:, None]
                    count = np.count_nonzero(left)
                    self.work[b + 1] += count
                    if count * 10 < d.size or b + 1 == len(self.words):
                        i, j = np.nonzero(left)
                        self.scan(best, words, qid, q[i], s + j, d[i, j], b + 1)
                        break
            best.settle()
            s, step = e, 4096


def _scan(rows: pa.Table, queries: pa.Table, levels: range, width: int, k: int, plan: Plan, splits: np.ndarray, alpha: float) -> tuple[np.ndarray, _Best, np.ndarray] | None:
    """Ids of the queries, what they found in the lists of one cell so many columns away, and the work of it."""
    if not rows.num_rows or not queries.num_rows:
        return None
    _, columns = _columns(width * 8, plan)
    place = int(np.searchsorted(np.cumsum(splits), rows["cell"][0].as_py(), "right"))
    table, part = place >> plan.parts, place & ((1 << plan.parts) - 1)
    low_bits = plan.k - plan.parts
    rb, qb = (joined(t["bits"].to_pylist(), np.uint8).reshape(-1, width) for t in (rows, queries))
    qid = joined_ints(queries["ids"].to_pylist())
    mask = (1 << low_bits) - 1
    lists = _Lists(rb, joined_ints(rows["ids"].to_pylist()), _values(rb, columns[table]) & mask, low_bits, alpha)
    value = _values(qb, columns[table])
    order = np.argsort(value, kind="stable")  # near queries look at the same lists
    value, qid, bound = value[order], qid[order], joined(queries["bounds"].to_pylist(), np.uint16).astype(np.int64)[order]
    words = np.ascontiguousarray(words64(qb[order]).T)
    away = np.bitwise_count((value >> low_bits) ^ part).astype(np.int64)
    best = _Best(bound, k)
    if not low_bits:
        lists.all(best, words, qid)
    else:
        for flips in levels:
            for a in range(min(flips, plan.part_flips) + 1):
                if flips - a <= low_bits:
                    lists.probe(best, words, qid, np.flatnonzero(away == a), value & mask, flips - a)
            best.settle()
    best.settle()
    return qid, best, lists.work


_FOUND = "bucket int, q binary, d binary, ids binary"


def _found(rows: pa.Table, queries: pa.Table, buckets: int, *args: object) -> pa.Table:
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names, out = ["bucket", "q", "d", "ids"], []
    if scanned := _scan(rows, queries, *args):
        qid, best, _ = scanned
        q, d, ids = best.found
        out = [(b, pack_ints(qid[q[at]]), d[at].astype(np.uint16).tobytes(), pack_ints(ids[at])) for b, at in by_bucket((mix64(qid[q].view(np.uint64)) % np.uint64(buckets)).astype(np.int64))]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, types)], names=names)


def _worked(rows: pa.Table, queries: pa.Table, *args: object) -> pa.Table:
    scanned = _scan(rows, queries, *args)
    work = scanned[2] if scanned else np.zeros(0, np.int64)
    return pa.table({"block": pa.array(np.arange(len(work)), pa.int32()), "pairs": pa.array(work)})


def _merged(cells: pa.Table, k: int) -> tuple[np.ndarray, _Best]:
    """Queries, and their k nearest over all cells."""
    q, ids = joined_ints(cells["q"].to_pylist()), joined_ints(cells["ids"].to_pylist())
    d = joined(cells["d"].to_pylist(), np.uint16).astype(np.int64)
    who, at = np.unique(q, return_inverse=True)
    best = _Best(np.full(len(who), 1 << 15), k)
    best.add(at, d, ids)
    best.settle()
    return who, best


def _bounds(cells: pa.Table, k: int) -> pa.Table:
    who, best = _merged(cells, k)
    full = best.bound < 1 << 15
    return pa.table({"id": who[full], "bound": best.bound[full].astype(np.int32)})


def _merge(cells: pa.Table, k: int) -> pa.Table:
    who, best = _merged(cells, k)
    a, d, ids = best.found
    return pa.table({"id": who[a], "near_id": ids, "distance": d.astype(np.int32)})


class _Search:
    """The cells of rows, and the rounds of queries over them."""

    def __init__(self, rows: DataFrame, queries: DataFrame, nbits: int, k: int, exhaustive: bool, alpha: float):
        width = nbits // 8
        rows = rows.select(F.col("id").cast("long").alias("id"), "bits").filter(F.col("id").isNotNull() & (F.length("bits") == width))
        n = rows.count()
        plan = plan_lists(n, nbits)
        if exhaustive:
            plan = Plan(1, plan.parts, plan.parts, plan.parts, plan.parts)
        splits = np.ones(plan.tables << plan.parts, dtype=np.int64)
        if n > ROWS_A_CELL:  # else no part can be larger
            for r in rows.mapInArrow(lambda x: _count(x, width, plan), _COUNTS).groupBy("part").agg(F.sum("n").alias("n")).collect():  # a number for each million rows
                splits[r.part] = math.ceil(r.n / ROWS_A_CELL)
        self.asked = rows.join(queries.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
        self.packed = rows.mapInArrow(lambda x: _pack_rows(x, width, plan, splits, k + 1), _CELLS)
        self.args, self.k, self.far, self.buckets = (width, k, plan, splits, alpha), k, nbits + 1, max(12, math.ceil(n / ROWS_A_CELL))
        split = plan.flips if plan.k > plan.parts and plan.flips else plan.flips + 1
        self.rounds = [r for r in (range(split), range(split, plan.flips + 1)) if len(r)]

    def cells(self, found: DataFrame | None):
        """Cells of rows and queries, whose bounds are those that ``found`` gives."""
        width, _, plan, splits, _ = self.args
        asked = self.asked.select("id", "bits", F.lit(self.far).alias("bound"))
        if found is not None:
            k = self.k
            bounds = found.groupBy("bucket").applyInArrow(lambda t: _bounds(t, k), "id long, bound int")
            asked = self.asked.join(bounds, "id", "left").select("id", "bits", F.coalesce("bound", F.lit(self.far)).alias("bound"))
        probing = asked.mapInArrow(lambda x: _pack_queries(x, width, plan, splits), _ASKED)
        return self.packed.groupBy("cell").cogroup(probing.groupBy("cell"))

    def found(self) -> list[DataFrame]:
        """What each round finds; the next starts from it, so that it is written."""
        out: list[DataFrame] = []
        for levels in self.rounds:
            out[-1:] = [checkpointed(x) for x in out[-1:]]
            out.append(self.cells(out[-1] if out else None).applyInArrow(self.scanner(_found, self.buckets, levels), _FOUND))
        return out

    def scanner(self, what: Callable[..., pa.Table], *first: object) -> Callable[[pa.Table, pa.Table], pa.Table]:
        args = (*first, *self.args)
        return lambda rows, queries: what(rows, queries, *args)


def nearest(rows: DataFrame, queries: DataFrame, nbits: int, k: int = 5, exhaustive: bool = False, alpha: float = ALPHA) -> DataFrame:
    """``id, near_id, distance``: for each distinct id of ``queries`` its k nearest other rows by differing bits.

    rows: ``id bigint, bits binary``; queries: ``id bigint``. Other columns are ignored. Rows whose bits are null or not
    nbits long, or whose id is null, take no part, neither as candidates nor as queries; queries without such a row give
    nothing. Repeated queries count once. Equal distances go to the smaller id. Fewer than k other rows give all of
    them that lists bring together; no rows give no result. ids are unique among rows; nbits is a multiple of 64. With exhaustive
    all rows are one list; the only losses left are those of the hypothesis test, and none with alpha = 0.
    """
    return reduce(DataFrame.unionByName, _Search(rows, queries, nbits, k, exhaustive, alpha).found()).groupBy("bucket").applyInArrow(lambda t: _merge(t, k), "id long, near_id long, distance int")


def scan_work(rows: DataFrame, queries: DataFrame, nbits: int, k: int = 5, exhaustive: bool = False, alpha: float = ALPHA) -> DataFrame:
    """``block, pairs``: the pairs of a query and a row that ``nearest`` looks at (block 0), and of them those that the test
    did not abandon after each block."""
    search = _Search(rows, queries, nbits, k, exhaustive, alpha)
    parts = [search.cells(f).applyInArrow(search.scanner(_worked, levels), "block int, pairs long") for levels, f in zip(search.rounds, [None, *search.found()])]
    return reduce(DataFrame.unionByName, parts).groupBy("block").agg(F.sum("pairs").alias("pairs"))
