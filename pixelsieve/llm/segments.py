"""Segment indexes: candidates for small Hamming distance and small edit distance without comparing all pairs.

Bits (``near_bits``): every row is seen as the set of its values at fixed groups of k bit positions, one group for each
table. Two rows fewer than ``below`` bits apart have, with a known chance, values of a table that differ in at most FLIPS
positions, so that ``plan_tables`` can choose the number of tables for a stated share of missed pairs at the largest
distance; nearer pairs are missed far less often. With exact the groups are as many as it takes for one of them always to
differ so little, and nothing is missed.

An entry of a table is one word of 64 bits, the row's value and, for the rest, more of its bits (a sketch), and its id: 12
bytes. A list holds the entries of one value, in blocks of equal words. Blocks are compared once for all their entries, which share the
answer: with the blocks of their own list and of the lists up to FLIPS positions away, skipping those whose words differ in
too many bits. Rows with equal bits are one entry: what is found for one of them holds for all. The distance of what
is left is measured.

Strings (``near_strings``): a string is cut into 2 * (tau + 1) segments by its length; the segments i and i + tau + 1
form one of tau + 1 pairs. At most tau edits leave at least one pair untouched, each of its segments at a place moved
by a known number of characters. Strings store their pairs by length and position; the other side looks up the
substrings at the places that tau edits allow. This is exact; each candidate is verified. Pairing a segment of the
front with one of the back keeps a common front (a directory) or back (an extension) from making a hot list.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Text, by_bucket, fixed, joined, joined_ints, mix64, pack_ints, run_starts, words64

#: Share of pairs at the largest distance that the tables may miss; it falls quickly below.
MISS = 1e-6
FLIPS = 2
#: Share of the meetings at the largest distance that the sketch may skip; the tables make up for it.
LOSS = 0.02
ROWS_A_BUCKET = 4_000_000
STRINGS_A_BUCKET = 2_000_000
#: Positions of a list's value that are looked up in an array.
ADDRESS = 24
AT_ONCE, PAIRS_AT_ONCE = 1 << 20, 1 << 20
SEED = 40_009
CELLS = "bucket int, words binary, codes binary"


class Plan(NamedTuple):
    """Tables of k positions, of which the first ``parts`` choose the part and may not differ; ``bound`` is the largest
    number of differing bits of the sketch."""

    tables: int
    k: int
    parts: int
    bound: int
    exact: bool


def within(nbits: int, far: int, columns: int, most: int) -> float:
    """Chance that of ``far`` differing bits at most so many lie in so many of nbits columns."""
    return sum(math.comb(columns, j) * math.comb(nbits - columns, far - j) for j in range(min(most, far, columns) + 1) if far - j <= nbits - columns) / math.comb(nbits, far)


def missed(tables: int, k: int, parts: int, nbits: int, far: int) -> float:
    """Chance that rows that differ in ``far`` bits meet in no table. The groups of as many tables as there is room for have no
    position in common, so that differences which one group holds are no longer there for the next."""
    out = 1.0
    apart = [math.comb(k, j) - (1 - LOSS) * (math.comb(k - parts, j) if j <= FLIPS else 0) for j in range(k + 1)]
    while tables > 0:
        m = min(tables, max(1, nbits // k))
        tables -= m
        ways = [1.0]  # to place so many of the differences in the first groups without a meeting
        for _ in range(m):
            ways = [sum(ways[i] * apart[j - i] for i in range(max(0, j - k), min(j, len(ways) - 1) + 1)) for j in range(min(far, len(ways) - 1 + k) + 1)]
        out *= sum(x * math.comb(nbits - m * k, far - j) for j, x in enumerate(ways)) / math.comb(nbits, far)
    return out


def plan_tables(n: int, nbits: int, below: int, miss: float = MISS, exact: bool = False) -> Plan:
    """Two rows meet in a table if their values differ in at most FLIPS positions, none of which chooses the part. Groups grow
    with the logarithm of n so that lists stay short."""
    far = min(below - 1, nbits)
    if exact:
        tables = far // (FLIPS + 1) + 1
        return Plan(tables, nbits // tables, 0, 64, True)
    parts = max(0, math.ceil(math.log2(max(1, n / ROWS_A_BUCKET))))
    k = max(parts + 1, min(40, max(8, math.ceil(math.log2(max(n, 2)))), max(1, nbits - below)))
    bound = next(x for x in range(65 - k) if within(nbits - k, min(far, nbits - k), 64 - k, x) >= 1 - LOSS)
    tables = 1
    while missed(tables, k, parts, nbits, far) > miss:
        tables += 1
    return Plan(tables, k, parts, bound, False)


@functools.lru_cache(maxsize=4)
def _positions(nbits: int, plan: Plan) -> np.ndarray:
    """For each table the positions whose bits make its word: those of the value, then those of the sketch."""
    rng = np.random.default_rng(SEED)
    order, out = rng.permutation(nbits), []
    per = max(1, nbits // plan.k)
    for t in range(plan.tables):
        if plan.exact:
            own = order[t * nbits // plan.tables : (t + 1) * nbits // plan.tables]
        else:
            if t and t % per == 0:
                order = rng.permutation(nbits)
            own = order[t % per * plan.k : (t % per + 1) * plan.k]
        out.append(np.r_[own, rng.permutation(np.setdiff1d(order, own))][:64])
    return np.stack(out)


def _value_mask(nbits: int, plan: Plan, table: int) -> np.uint64:
    k = (table + 1) * nbits // plan.tables - table * nbits // plan.tables if plan.exact else plan.k
    return np.uint64(((1 << min(k, 64)) - 1) << (64 - min(k, 64)))


def table_words(rows: np.ndarray, plan: Plan) -> Iterator[np.ndarray]:
    """The words of rows of bytes, table by table."""
    bits = np.unpackbits(rows, axis=1)
    for at in _positions(rows.shape[1] * 8, plan):
        yield np.ascontiguousarray(np.packbits(bits[:, at], axis=1)).view(">u8").ravel().astype(np.uint64)


def _part(words: np.ndarray, plan: Plan) -> np.ndarray:
    return (words >> np.uint64(64 - plan.parts)).astype(np.int64) if plan.parts else np.zeros(len(words), np.int64)


def _split(ids: np.ndarray, splits: np.ndarray | int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.asarray(splits).astype(np.uint64)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], width: int, plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            buckets = [(t << plan.parts) + _part(w, plan) for t, w in enumerate(table_words(fixed(batch.column(1), width), plan))]
            which, n = np.unique(np.concatenate(buckets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(n)], names=["bucket", "n"])


def _cell(first: np.ndarray, splits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cell in which the splits x <= y of a bucket meet."""
    return first + x * splits - x * (x - 1) // 2 + y - x


def _firsts(splits: np.ndarray) -> np.ndarray:
    cells = splits * (splits + 1) // 2
    return np.cumsum(cells) - cells


def emit(batches: Iterator[pa.RecordBatch], width: int, plan: Plan, splits: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packs the words of ``id, bits, side`` by cell; a bucket in several splits has a cell for every two of them."""
    splits = np.ones(plan.tables << plan.parts, dtype=np.int64) if splits is None else splits
    firsts = _firsts(splits)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        code = ids * 4 + batch.column(2).to_numpy()
        cells = []
        for t, words in enumerate(table_words(fixed(batch.column(1), width), plan)):
            bucket = (t << plan.parts) + _part(words, plan)
            s = splits[bucket]
            own = _split(ids, s)
            for other in range(int(s.max())):
                at = np.flatnonzero(other < s)
                x, y = np.minimum(own[at], other), np.maximum(own[at], other)
                cells += [(c, words[at[p]].tobytes(), pack_ints(code[at[p]])) for c, p in by_bucket(_cell(firsts[bucket[at]], s[at], x, y))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "words", "codes"])


def expand(entry: np.ndarray, lo: np.ndarray, hi: np.ndarray, at_once: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, j) for every j in [lo, hi) of each entry, in slices of bounded size."""
    n = hi - lo
    entry, lo, n = entry[n > 0], lo[n > 0], n[n > 0]
    total = np.cumsum(n)
    start = 0
    while start < len(n):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + at_once, "right")))
        m = n[start:stop]
        within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(entry[start:stop], m), np.repeat(lo[start:stop], m) + within
        start = stop


class _Blocks:
    """Entries of one part of a table, in lists of blocks of equal words."""

    def __init__(self, words: np.ndarray, codes: np.ndarray, skip: int, address: int):
        order = np.argsort(words, kind="stable")
        words, self.codes = words[order], codes[order]
        self.start, self.length = run_starts(words)
        self.words = words[self.start]
        self.shift, self.mask = np.uint64(64 - skip - address), np.uint64((1 << address) - 1)
        value = self.lists_of(self.words)
        self.first, self.blocks = run_starts(value)
        self.value = value[self.first]
        self.index = np.full(1 << address, -1, dtype=np.int32)
        self.index[self.value] = np.arange(len(self.value))

    def lists_of(self, words: np.ndarray) -> np.ndarray:
        return ((words >> self.shift) & self.mask).astype(np.int64)

    def entries(self, i: np.ndarray, other: _Blocks, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes of the entries of blocks i beside those of the blocks j of the other."""
        alone = (self.length[i] == 1) & (other.length[j] == 1)
        yield self.codes[self.start[i[alone]]], other.codes[other.start[j[alone]]]
        i, j = i[~alone], j[~alone]
        for at, own in expand(np.arange(len(i)), self.start[i], self.start[i] + self.length[i], PAIRS_AT_ONCE):
            lo = other.start[j[at]]
            for e, theirs in expand(own, lo, lo + other.length[j[at]], PAIRS_AT_ONCE):
                yield self.codes[e], other.codes[theirs]


def _masks(address: int) -> list[tuple[int, int]]:
    """(number of up to FLIPS of so many bits, the highest of them)."""
    return [(sum(1 << i for i in c), max(c)) for n in range(1, FLIPS + 1) for c in itertools.combinations(range(address), n)]


def _test(a: np.ndarray, b: np.ndarray, value: np.uint64, bound: int) -> np.ndarray:
    """Places where the words differ in few enough bits of the value and of the sketch."""
    x = a ^ b
    return np.flatnonzero((np.bitwise_count(x & value) <= FLIPS) & (np.bitwise_count(x & ~value) <= bound))


def _met(a: _Blocks, la: np.ndarray, b: _Blocks, lb: np.ndarray, value: np.uint64, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the lists la of a and lb of b, side by side, that pass the test."""
    single = (a.blocks[la] == 1) & (b.blocks[lb] == 1)
    i, j = a.first[la[single]], b.first[lb[single]]
    ok = _test(a.words[i], b.words[j], value, bound)
    yield i[ok], j[ok]
    la, lb = la[~single], lb[~single]
    for of, own in expand(lb, a.first[la], a.first[la] + a.blocks[la], AT_ONCE):
        for i, j in expand(own, b.first[of], b.first[of] + b.blocks[of], AT_ONCE):
            ok = _test(a.words[i], b.words[j], value, bound)
            yield i[ok], j[ok]


def _own_pairs(a: _Blocks, address: int, value: np.uint64, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of entries that pass the test among themselves, each pair once."""
    many = np.flatnonzero(a.length > 1)  # equal words
    for b, e in expand(many, a.start[many], a.start[many] + a.length[many], PAIRS_AT_ONCE):
        for x, y in expand(e, e + 1, a.start[b] + a.length[b], PAIRS_AT_ONCE):
            yield a.codes[x], a.codes[y]
    at = np.arange(len(a.words))
    end = np.repeat(a.first + a.blocks, a.blocks)
    for i, j in expand(at, at + 1, end, AT_ONCE):
        ok = _test(a.words[i], a.words[j], value, bound)
        yield from a.entries(i[ok], a, j[ok])
    lower = [np.flatnonzero((a.value >> b) & 1 == 0) for b in range(address)]
    for mask, top in _masks(address):
        la = lower[top]
        lb = a.index[a.value[la] ^ mask]
        has = np.flatnonzero(lb >= 0)
        for i, j in _met(a, la[has], a, lb[has], value, bound):
            yield from a.entries(i, a, j)


def _cross_pairs(a: _Blocks, b: _Blocks, address: int, value: np.uint64, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of entries of a beside those of b that pass the test."""
    for mask in (0, *(m for m, _ in _masks(address))):
        lb = b.index[a.value ^ mask]
        has = np.flatnonzero(lb >= 0)
        for i, j in _met(a, has, b, lb[has], value, bound):
            yield from a.entries(i, b, j)


def _blocks(words: np.ndarray, codes: np.ndarray, plan: Plan, address: int) -> _Blocks:
    return _Blocks(words, codes, plan.parts, address)


def _address(n: int, value: np.uint64, plan: Plan) -> int:
    return max(0, min(ADDRESS, int(value).bit_count() - plan.parts, max(8, math.ceil(math.log2(max(2, n))))))


def _batched(pairs: Iterator[tuple[np.ndarray, np.ndarray]], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Pairs of ids, those of one batch once."""
    kept: list[np.ndarray] = []

    def batch() -> pa.RecordBatch:
        both = np.unique(np.concatenate([np.empty((0, 2), dtype=np.int64), *kept]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=list(names))

    for x, y in pairs:
        if len(x):
            kept.append(np.stack([x, y], axis=1))
            if sum(map(len, kept)) > PAIRS_AT_ONCE:
                yield batch()
                kept = []
    yield batch()


def _probe(nbits: int, plan: Plan, splits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates of one cell: new entries (side 2 or 3) beside old ones, and those of side 3 among themselves."""
    firsts = _firsts(splits)

    def pairs(cell: int, words: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bucket = int(np.searchsorted(firsts, cell, "right")) - 1
        diagonal = splits[bucket] == 1 or cell in _cell(firsts[bucket], splits[bucket], *[np.arange(splits[bucket])] * 2)
        value = _value_mask(nbits, plan, bucket >> plan.parts)
        address = _address(len(words), value, plan)
        new = codes & 2 > 0
        a = _blocks(words[new], codes[new], plan, address)
        found = _own_pairs(a, address, value, plan.bound)
        if not new.all():
            found = itertools.chain(found, _cross_pairs(a, _blocks(words[~new], codes[~new], plan, address), address, value, plan.bound))
        for x, y in found:
            x, y = x >> 2, y >> 2
            if not diagonal:
                other = _split(x, splits[bucket]) != _split(y, splits[bucket])
                x, y = x[other], y[other]
            yield np.minimum(x, y), np.maximum(x, y)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = pa.Table.from_batches(batches)
        words, codes = joined(cells["words"].to_pylist(), np.uint64), joined_ints(cells["codes"].to_pylist())
        yield from _batched(pairs(cells["bucket"][0].as_py(), words, codes), ("a", "b"))

    return probe


def _between(old: list[tuple], new: list[tuple], bucket: int, nbits: int, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(id of old, id of new) of the partners across two collections of cells (words, codes) of one bucket."""
    (w1, c1), (w2, c2) = ((joined(w, np.uint64), joined_ints(c)) for w, c in (tuple(zip(*x)) for x in (old, new)))
    value = _value_mask(nbits, plan, bucket >> plan.parts)
    address = _address(max(len(w1), len(w2)), value, plan)
    for x, y in _cross_pairs(_blocks(w2, c2, plan, address), _blocks(w1, c1, plan, address), address, value, plan.bound):
        yield y >> 2, x >> 2


def probe_held(batches: Iterator[pa.RecordBatch], held: dict[int, list[tuple]], nbits: int, plan: Plan) -> Iterator[pa.RecordBatch]:
    """Stored cells against those of a small batch."""
    for batch in batches:
        for bucket, *cell in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if bucket in held:
                yield from _batched(_between([tuple(cell)], held[bucket], bucket, nbits, plan), ("old", "new"))


def probe_both(old: pa.Table, new: pa.Table, nbits: int, plan: Plan) -> pa.Table:
    """Stored cells of a bucket against those of a large batch."""
    schema = pa.schema([("old", pa.int64()), ("new", pa.int64())])
    if not old.num_rows or not new.num_rows:
        return schema.empty_table()
    sides = ([tuple(r.values()) for r in t.select(["words", "codes"]).to_pylist()] for t in (old, new))
    return pa.Table.from_batches(_batched(_between(*sides, old["bucket"][0].as_py(), nbits, plan), ("old", "new")), schema)


def measure(batches: Iterator[pa.RecordBatch], width: int, below: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        d = np.bitwise_count(words64(fixed(batch.column(2), width)) ^ words64(fixed(batch.column(3), width))).sum(axis=1, dtype=np.int32)
        ok = d < below
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[ok]), pa.array(batch.column(1).to_numpy()[ok]), pa.array(d[ok])], names=["a", "b", "distance"])


def near_bits(rows: DataFrame, nbits: int, below: int, n: int | None = None, miss: float = MISS, exact: bool = False) -> DataFrame:
    """``a, b, distance``: pairs a < b of ids whose bits differ in fewer than ``below`` places, each once.

    rows: ``id bigint`` (unique, within 61 bits), ``bits binary`` (all nbits long, distinct: callers give one row for
    each set of equal bits) and ``side int``: 1 takes part only against rows of side 2 or 3, which also take part among
    themselves. nbits is a multiple of 64. An empty table gives no pairs. A pair at the largest distance is missed with a chance of
    ``miss``, with exact never; then a table is one task and measures far more pairs, so it is for some millions of rows.
    """
    n = rows.count() if n is None else n
    width = nbits // 8
    plan = plan_tables(n, nbits, below, miss, exact)
    rows = rows.select(F.col("id").cast("long").alias("id"), "bits", F.col("side").cast("long").alias("side"))
    splits = np.ones(plan.tables << plan.parts, dtype=np.int64)
    if n > ROWS_A_BUCKET:  # else no bucket can be larger; a list that many rows share is split like any other
        for r in rows.mapInArrow(lambda x: _count(x, width, plan), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a number for each table and each ROWS_A_BUCKET rows
            splits[r.bucket] = math.ceil(r.n / (2 * ROWS_A_BUCKET))
    cells = rows.mapInArrow(lambda x: emit(x, width, plan, splits), CELLS)
    pairs = cells.groupBy("bucket").applyInArrow(_probe(nbits, plan, splits), "a long, b long").distinct()
    left, right = rows.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), rows.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "bits_a", "bits_b")
    return both.mapInArrow(lambda x: measure(x, width, below), "a long, b long, distance int")


def moves(tau: int, delta: int) -> list[tuple[int, int]]:
    """Ways in which tau edits that change the length by delta can move two untouched segments."""
    r = range(-tau, tau + 1)
    return [(s, t) for s in r for t in r if abs(s) + abs(t - s) + abs(delta - t) <= tau]


def _cuts(length: np.ndarray, i: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of m in strings of these lengths."""
    start = i * length // m
    return start, (i + 1) * length // m - start


def _tokens(first: np.ndarray, second: np.ndarray, length: np.ndarray, pair: int) -> np.ndarray:
    return mix64(mix64(first + np.uint64(pair + 1)) ^ (second * np.uint64(0x9E3779B97F4A7C15)) ^ (length.astype(np.uint64) << np.uint64(20)))


def _emit_strings(batches: Iterator[pa.RecordBatch], tau: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """side 1 stores its segments, side 2 looks up substrings, side 3 does both."""
    m, pairs = 2 * (tau + 1), tau + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, side = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        text = Text(batch.column(1).to_pylist())
        tokens, who, kind = [], [], []
        for p in range(pairs):
            at = np.flatnonzero(side & 1)
            length, base = text.lengths[at], text.starts[:-1][at]
            (s1, l1), (s2, l2) = _cuts(length, p, m), _cuts(length, p + pairs, m)
            tokens.append(_tokens(text.windows(base + s1, l1), text.windows(base + s2, l2), length, p))
            who.append(at)
            kind.append(np.zeros(len(at), dtype=np.int64))
            at = np.flatnonzero(side & 2)
            for delta in range(-tau, tau + 1):  # own length less the stored one's
                for d1, d2 in moves(tau, delta):
                    own = text.lengths[at]
                    stored = own - delta
                    (s1, l1), (s2, l2) = _cuts(stored, p, m), _cuts(stored, p + pairs, m)
                    a, b = s1 + d1, s2 + d2
                    ok = (stored >= 0) & (a >= 0) & (b >= a + l1) & (b + l2 <= own)
                    base = text.starts[:-1][at[ok]]
                    tokens.append(_tokens(text.windows(base + a[ok], l1[ok]), text.windows(base + b[ok], l2[ok]), stored[ok], p))
                    who.append(at[ok])
                    kind.append(np.ones(ok.sum(), dtype=np.int64))
        tokens, who, kind = np.concatenate(tokens), np.concatenate(who), np.concatenate(kind)
        cells = [(b, tokens[at].tobytes(), pack_ints(ids[who[at]] * 2 + kind[at])) for b, at in by_bucket((tokens % np.uint64(buckets)).astype(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "tokens", "codes"])


STRING_CELLS = "bucket int, tokens binary, codes binary"


def string_buckets(n: int) -> int:
    return max(24, math.ceil(n / STRINGS_A_BUCKET) * 24)


def string_cells(rows: DataFrame, tau: int, buckets: int) -> DataFrame:
    """Packed segments of ``id, s, side``: side 1 stores, 2 looks up, 3 does both."""
    rows = rows.select(F.col("id").cast("long").alias("id"), "s", F.col("side").cast("int").alias("side"))
    return rows.mapInArrow(lambda x: _emit_strings(x, tau, buckets), STRING_CELLS)


def _met_tokens(stored: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(stored code, asking code) of equal tokens, as slices of bounded size."""
    (ts, cs), (ta, ca) = stored, asked
    order = np.argsort(ts, kind="stable")
    ts, cs = ts[order], cs[order]
    for i, j in expand(np.arange(len(ta)), np.searchsorted(ts, ta, "left"), np.searchsorted(ts, ta, "right"), PAIRS_AT_ONCE):
        yield cs[j] >> 1, ca[i] >> 1


def _string_cell(rows: pa.Table | list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    tokens, codes = (rows["tokens"].to_pylist(), rows["codes"].to_pylist()) if isinstance(rows, pa.Table) else tuple(zip(*rows))
    return joined(tokens, np.uint64), joined_ints(codes)


def _probe_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, codes = _string_cell(pa.Table.from_batches(batches))
    stored, asked = codes & 1 == 0, codes & 1 == 1
    met = _met_tokens((tokens[stored], codes[stored]), (tokens[asked], codes[asked]))
    yield from _batched(((np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]) for a, b in met), ("a", "b"))


def strings_held(batches: Iterator[pa.RecordBatch], held: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
    """Stored segments against those of a small batch."""
    for batch in batches:
        for bucket, *cell in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if bucket in held:
                yield from _batched(_met_tokens(_string_cell([tuple(cell)]), _string_cell(held[bucket])), ("old", "new"))


def strings_both(old: pa.Table, new: pa.Table) -> pa.Table:
    """Stored segments of a bucket against those of a large batch."""
    schema = pa.schema([("old", pa.int64()), ("new", pa.int64())])
    if not old.num_rows or not new.num_rows:
        return schema.empty_table()
    return pa.Table.from_batches(_batched(_met_tokens(_string_cell(old), _string_cell(new)), ("old", "new")), schema)


def near_strings(rows: DataFrame, tau: int, n: int | None = None) -> DataFrame:
    """``a, b``: pairs a < b of ids whose strings are at most ``tau`` edits apart, each once; exact.

    rows: ``id bigint`` (unique, within 62 bits), ``s string`` (not null, distinct) and ``side int``: 1 takes part only
    against rows of side 2 or 3; 3 also among themselves. Lengths count code points; empty strings are strings.
    """
    n = rows.count() if n is None else n
    cells = string_cells(rows, tau, string_buckets(n))
    rows = rows.select(F.col("id").cast("long").alias("id"), "s")
    pairs = cells.groupBy("bucket").applyInArrow(_probe_strings, "a long, b long").distinct()
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").join(rows.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b")
    return both.filter(F.levenshtein("s_a", "s_b", tau) >= 0).select("a", "b")
