"""Long exact spans that several records share (problem 9).

Windows of ``shortest - PERIOD + 1`` characters are hashed only where their position modulo PERIOD lies in a difference
cover: for any two positions there is a shift below PERIOD that brings both onto the cover. A span of ``shortest``
characters holds PERIOD windows, so whatever its places in two texts, one window of it is hashed in both at the same
place of the span. Texts that share a hashed window become a pair with the difference of the two positions, and the
pair is compared along that difference: every run of equal characters of the least length is found whole and exactly.

Equal texts are one class, compared once. An anchor costs 6 bytes of hash and 2 of position in the shuffle.

An anchor in more than CROWD places gives no pairs; a batch of texts sends no more than one place beyond that of it. Around such anchors all windows of
the full length are looked at. Pairs are then those of classes with an equal one. How much of a text is shared needs no
pairs there: a window is shared if two classes have it, which two of its places in each batch are enough to tell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Text, by_bucket, checkpointed, joined, joined_ints, mix64, pack_ints, run_starts

SHORTEST = 400
#: A perfect difference set modulo 133: every residue but 0 is a difference of exactly one pair. Fixed values.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
ANCHORS_A_BUCKET = 2_000_000
CHARS_AT_ONCE = 1_000_000
#: Up to so many ids (8 bytes each) go to every task to pick out the texts of pairs; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: An anchor in more places than this is looked at again with windows of the full length.
CROWD = 100
CROWDED_AT_ONCE = 500_000
#: A pair with more shifts than this is compared by windows.
MANY_SHIFTS = 64
ROWS_AT_ONCE = 200_000
#: Of a hash 48 bits are kept.
SHIFT = np.uint64(16)


def cover_for(shortest: int) -> tuple[int, tuple[int, ...]]:
    """(period, cover) for spans of so many characters; short spans need a shorter period for windows to stay long."""
    if shortest >= 3 * PERIOD:
        return PERIOD, COVER
    period = max(1, shortest // 3)
    step = max(1, math.isqrt(period))
    return period, tuple(sorted({i for i in range(min(step, period))} | {i * step % period for i in range(1, -(-period // step) + 1)}))


def _slices(lengths: list[int], at_once: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together, at least one text each."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > at_once:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def _first_places(h: np.ndarray, most: int) -> np.ndarray:
    """Positions of the values, of equal ones the first ``most``."""
    order = np.argsort(h, kind="stable")
    start, length = run_starts(h[order])
    return np.sort(order[np.arange(len(h)) - np.repeat(start, length) < most])


def _places(text: Text, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of the anchors, by text and position."""
    period, cover = cover_for(shortest)
    window, places = shortest - period + 1, np.array(cover)
    # text by text the positions of the cover, cut to those that leave room for a window
    n = (np.maximum(text.lengths - window, -1) // period + 1) * len(cover)
    of = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = within // len(cover) * period + places[within % len(cover)]
    ok = at + window <= text.lengths[of]
    of, at = of[ok], at[ok]
    return of, at, mix64(text.windows(text.starts[:-1][of] + at, window))


def _around(text: Text, of: np.ndarray, at: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and position of all windows of the full length that hold one of the anchors."""
    period = cover_for(shortest)[0]
    around = np.unique((of << 40) + at + period - np.arange(period)[:, None])
    of, at = around >> 40, (around & ((1 << 40) - 1)) - period
    ok = (at >= 0) & (at + shortest <= text.lengths[of])
    return of[ok], at[ok]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Text, list]]:
    """Classes and their texts, some at a time, with what a third column says of them."""
    for batch in batches:
        cls = batch.column(0).to_numpy()
        _, first = np.unique(cls, return_index=True)  # copies within the batch
        cls, texts = cls[first], batch.column(1).take(pa.array(first)).to_pylist()
        more = batch.column(2).take(pa.array(first)).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
        for begin, stop in _slices([len(x) for x in texts]):
            yield cls[begin:stop], Text(texts[begin:stop]), more[begin:stop]


_CELLS = "bucket int, classes binary, counts binary, low binary, high binary, gaps binary"


def _cells(cells: list[tuple]) -> Iterator[pa.RecordBatch]:
    if cells:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), (pa.int32(), *[pa.binary()] * 5))], names=[x.split()[0] for x in _CELLS.split(", ")])


def _cell(bucket: int, cls: np.ndarray, of: np.ndarray, at: np.ndarray, low: bytes, high: bytes) -> tuple:
    """Places, by text and position, with their hashes."""
    k, counts = np.unique(of, return_counts=True)
    return bucket, pack_ints(cls[k]), pack_ints(counts), low, high, _gaps(of, at)


def _anchors(batches: Iterator[pa.RecordBatch], shortest: int, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """Packs the anchors of the texts by bucket: hash, class and position, at most ``most`` places of each."""
    for cls, text, _ in _texts(batches):
        of, at, h = _places(text, shortest)
        few = _first_places(h, most)
        of, at, h = of[few], at[few], h[few]
        cells = ((b, p, (h[p] >> SHIFT)) for b, p in by_bucket((h % np.uint64(buckets)).astype(np.int64)))
        yield from _cells([_cell(b, cls, of[p], at[p], x.astype(np.uint32).tobytes(), (x >> np.uint64(32)).astype(np.uint16).tobytes()) for b, p, x in cells])


def _looked_at(batches: Iterator[pa.RecordBatch], shortest: int, crowded: np.ndarray | None) -> Iterator[tuple[np.ndarray, Text, np.ndarray, np.ndarray]]:
    """All windows of the full length around anchors whose hash, cut to 48 bits, is among the crowded ones or, without them,
    around the positions that a third column gives."""
    for cls, text, more in _texts(batches):
        if crowded is not None:
            of, at, h = _places(text, shortest)
            hit = np.isin(h >> SHIFT, crowded)
            of, at = of[hit], at[hit]
        else:
            given = [joined_ints(x) for x in more]
            of, at = np.repeat(np.arange(len(given)), [len(x) for x in given]), np.concatenate([np.empty(0, np.int64), *given])
        yield cls, text, *_around(text, of, at, shortest)


def _full_windows(batches: Iterator[pa.RecordBatch], shortest: int, buckets: int, crowded: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Like _anchors, of the windows that are looked at."""
    for cls, text, of, at in _looked_at(batches, shortest, crowded):
        h = mix64(text.windows(text.starts[:-1][of] + at, shortest))
        cells = ((b, p, (h[p] >> SHIFT)) for b, p in by_bucket((h % np.uint64(buckets)).astype(np.int64)))
        yield from _cells([_cell(b, cls, of[p], at[p], x.astype(np.uint32).tobytes(), (x >> np.uint64(32)).astype(np.uint16).tobytes()) for b, p, x in cells])


def _of_two(cls: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places by their two hashes and class; whether each one's window has several classes; whether it is the first of its
    window or the first of another class."""
    order = np.lexsort((cls, two, one))
    one, two, cls = one[order], two[order], cls[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)]
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(one)])
    several = np.repeat(cls[start] != cls[start + length - 1], length) if len(start) else np.zeros(0, bool)
    last = np.zeros(len(one), dtype=bool)
    last[start + length - 1] = True
    return order, several, new | last


def _windows(batches: Iterator[pa.RecordBatch], shortest: int, buckets: int, crowded: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Packs the windows that are looked at with two hashes, together 128 bits. Those that several classes here have are known to be shared
    and go to bucket -1; of them the places of two classes go on too."""
    half = shortest // 2
    for cls, text, of, at in _looked_at(batches, shortest, crowded):
        start = text.starts[:-1][of] + at
        one = mix64(text.windows(start, shortest))
        two = mix64(text.windows(start, half)) ^ (text.windows(start + half, shortest - half) * np.uint64(0xD6E8FEB86659FD93))
        order, several, ends = _of_two(cls[of], one, two)
        known, go = np.sort(order[several]), np.sort(order[~several | ends])
        cells = [_cell(-1, cls, of[known], at[known], b"", b"")] if len(known) else []
        cells += [_cell(b, cls, of[go[p]], at[go[p]], one[go[p]].tobytes(), two[go[p]].tobytes()) for b, p in by_bucket((one[go] % np.uint64(buckets)).astype(np.int64))]
        yield from _cells(cells)


def _shared(cells: pa.Table) -> pa.Table:
    """``code, starts``: the windows of each class that another class has too."""
    cls, at = _unpacked(cells)
    if cells["bucket"][0].as_py() >= 0:
        order, several, _ = _of_two(cls, joined(cells["low"].to_pylist(), np.uint64), joined(cells["high"].to_pylist(), np.uint64))
        cls, at = cls[order[several]], at[order[several]]
    out = [(c, pack_ints(at[p])) for c, p in by_bucket(cls)]
    return pa.table({"code": pa.array([c for c, _ in out], pa.int64()), "starts": pa.array([x for _, x in out], pa.binary())})


def _joined_up(windows: pa.Table, shortest: int) -> pa.Table:
    """``code, s, e``: the stretches that a class's windows cover."""
    at = np.unique(joined_ints(windows["starts"].to_pylist()))
    new = np.flatnonzero(np.r_[True, np.diff(at) > shortest])
    last = np.r_[new[1:] - 1, len(at) - 1]
    return pa.table({"code": np.full(len(new), windows["code"][0].as_py()), "s": at[new], "e": at[last] + shortest})


def _gaps(of: np.ndarray, at: np.ndarray) -> bytes:
    """Positions as the difference to the one before in the same text, in 16 bits if all fit."""
    gap = np.diff(at, prepend=0)
    new = np.r_[True, of[1:] != of[:-1]]
    gap[new] = at[new]
    return (b"\2" + gap.astype(np.uint16).tobytes()) if not len(gap) or gap.max() < 1 << 16 else (b"\4" + gap.astype(np.uint32).tobytes())


def _positions(gaps: bytes, counts: np.ndarray) -> np.ndarray:
    gap = np.frombuffer(gaps, dtype=np.uint16 if gaps[0] == 2 else np.uint32, offset=1).astype(np.int64)
    total = np.cumsum(gap)
    first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
    return total - np.repeat(total[first] - gap[first], counts)


def _partners(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of places with equal hashes, of sorted hashes, in slices by their difference."""
    start, length = run_starts(h)
    end, i, step = np.repeat(start + length, length), np.arange(len(h)), 1
    while len(i):
        keep = i + step < end
        i, end = i[keep], end[keep]
        yield i, i + step
        step += 1


def _unpacked(cells: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Class and position of the places in cells."""
    cls, at = [], []
    for c, n, g in zip(cells["classes"].to_pylist(), cells["counts"].to_pylist(), cells["gaps"].to_pylist()):
        n = joined_ints([n])
        cls.append(np.repeat(joined_ints([c]), n))
        at.append(_positions(g, n))
    return np.concatenate(cls), np.concatenate(at)


def _match(cells: pa.Table, most: int | None) -> pa.Table:
    """Pairs of classes with equal anchors: ``a < b`` and the position in a less that in b.

    An anchor in more than ``most`` places gives no pairs but its hash as ``a``, with null as ``b``. Without ``most`` the
    anchors are windows of the full length, and classes become pairs without a position.
    """
    cls, at = _unpacked(cells)
    h = joined(cells["low"].to_pylist(), np.uint32).astype(np.uint64) | (joined(cells["high"].to_pylist(), np.uint16).astype(np.uint64) << np.uint64(32))
    order = np.argsort(h, kind="stable")
    _, lengths = run_starts(h[order])
    order = order[np.repeat(lengths > 1, lengths)]  # most anchors are alone
    order = order[np.lexsort((at[order], cls[order], h[order]))]
    h, cls, at = h[order], cls[order], at[order]
    crowded = np.empty(0, np.int64)
    if most is None:
        keep = np.r_[True, (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])][: len(h)]
    else:
        start, length = run_starts(h)
        crowded = h[start[length > most]].astype(np.int64)
        keep = np.repeat(length <= most, length)
    h, cls, at = h[keep], cls[keep], at[keep]
    out, waiting = [np.empty((0, 3), dtype=np.int64)], 0
    for a, b in _partners(h):
        other = cls[a] != cls[b]  # sorted by class within equal hashes
        shift = at[a] - at[b] if most is not None else np.zeros(len(a), np.int64)
        out.append(np.unique(np.stack([cls[a], cls[b], shift], axis=1)[other], axis=0))
        waiting += len(out[-1])
        if waiting > 4_000_000:
            out = [np.unique(np.concatenate(out), axis=0)]
            waiting = 0
    pairs = np.unique(np.concatenate(out), axis=0)
    null = pa.nulls(len(crowded), pa.int64())
    shift = pa.array(pairs[:, 2].copy()) if most is not None else pa.nulls(len(pairs), pa.int64())
    cols = [pa.chunked_array([pairs[:, 0].copy(), crowded]), pa.chunked_array([pa.array(pairs[:, 1].copy()), null]), pa.chunked_array([shift, null])]
    return pa.table(cols, names=["a", "b", "shift"])


def _along(x: np.ndarray, y: np.ndarray, shifts: list[int], shortest: int) -> Iterator[tuple[int, int, int]]:
    """(start in x, start in y, length) of the runs along each shift."""
    for s in shifts:
        xs, ys = max(0, s), max(0, -s)
        n = min(len(x) - xs, len(y) - ys)
        same = np.r_[False, x[xs : xs + n] == y[ys : ys + n], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i >= shortest:
                yield xs + i, ys + i, j - i


def _by_windows(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, shortest: int) -> Iterator[tuple[int, int, int]]:
    """Runs that cover whatever x shares with y: whole where y has it in one piece, else in pieces of the least length."""
    order = np.argsort(hy, kind="stable")
    place = np.searchsorted(hy[order], hx)
    hit = hy[order[np.minimum(place, len(hy) - 1)]] == hx
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
        first, n = int(order[place[i]]), j - i + shortest - 1
        if np.array_equal(x[i : i + n], y[first : first + n]):
            yield i, first, n
        else:
            for k in sorted({*range(i, j, shortest), j - 1}):
                other = int(order[place[k]])
                if np.array_equal(x[k : k + shortest], y[other : other + shortest]):
                    yield k, other, shortest


def _true_hashes(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, shortest: int) -> bool:
    """Whether all windows of x and y with the hash of a window of y equal the first such window."""
    known, first = np.unique(hy, return_index=True)
    for t, h in ((x, hx), (y, hy)):
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        at = np.flatnonzero(known[place] == h)
        rep = first[place[at]]
        new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(rep) != 1)][: len(at)])
        for i, k, n in zip(at[new].tolist(), rep[new].tolist(), np.diff(np.r_[new, len(at)]).tolist()):
            if not np.array_equal(t[i : i + n + shortest - 1], y[k : k + n + shortest - 1]):
                return False
    return True


def _edges(hx: np.ndarray, hy: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with hx[i] == hy[j] and cx[i] != cy[j], by i - j and then i."""
    known, ry = np.unique(hy, return_inverse=True)
    place = np.minimum(np.searchsorted(known, hx), len(known) - 1)
    i = np.flatnonzero(known[place] == hx)
    r = place[i].astype(np.int64) << 22  # above any code point
    key = (ry.astype(np.int64) << 22) + cy
    order = np.argsort(key, kind="stable")
    key = key[order]
    parts = []
    for lo, hi in ((r, r + cx[i]), (r + cx[i] + 1, r + (1 << 22))):
        lo, hi = np.searchsorted(key, lo), np.searchsorted(key, hi)
        n = hi - lo
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        parts.append((np.repeat(i, n), order[np.repeat(lo, n) + within]))
    i, j = (np.concatenate(k) for k in zip(*parts))
    by = np.lexsort((i, i - j))
    return i[by], j[by]


def _every_run(x: np.ndarray, y: np.ndarray, hx: np.ndarray, hy: np.ndarray, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(start in x, start in y, length) of all runs that cannot be made longer, along whatever shift. The work follows the
    windows and the runs: a run begins at equal windows behind different characters and ends at the next ones before such."""
    if not _true_hashes(x, y, hx, hy, shortest):
        number: dict[bytes, int] = {}
        hx, hy = (np.array([number.setdefault(t[i : i + shortest].tobytes(), len(number)) for i in range(len(t) - shortest + 1)]) for t in (x, y))
    px, py = x.astype(np.int64) + 2, y.astype(np.int64) + 2  # 0 and 1 stand for no character
    i, j = _edges(hx, hy, np.r_[0, px[: len(hx) - 1]], np.r_[1, py[: len(hy) - 1]])
    end, _ = _edges(hx, hy, np.r_[px[shortest:], 0], np.r_[py[shortest:], 1])
    return zip(i.tolist(), j.tolist(), (end - i + shortest).tolist())


def _extend(batches: Iterator[pa.RecordBatch], shortest: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Runs of at least ``shortest`` equal characters of each pair of texts: along each of its shifts, or, where there are
    many or none is known, as in repetitive texts, by all windows of both; then with every all runs whole, else runs
    that cover the same characters."""

    def packed(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "start_a", "start_b", "length"])

    for batch in batches:
        rows = []
        for a, b, shifts, whole, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(6))):
            tx, ty = Text([ta]), Text([tb])
            x, y = tx.points, ty.points
            if whole or len(shifts) > MANY_SHIFTS:
                hx, hy = (t.windows(np.arange(len(t.points) - shortest + 1), shortest) for t in (tx, ty))
                if every:
                    runs = _every_run(x, y, hx, hy, shortest)
                else:
                    runs = {*_by_windows(x, y, hx, hy, shortest), *((i, k, n) for k, i, n in _by_windows(y, x, hy, hx, shortest))}
            else:
                runs = _along(x, y, shifts, shortest)
            for r in runs:
                rows.append((a, b, *r))
                if len(rows) == ROWS_AT_ONCE:
                    yield packed(rows)
                    rows = []
        yield packed(rows)


def _ready(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def text_classes(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, cls, code``: equal texts have the smallest doc_id among them as their class; shorter texts are left out.

    code is a 64-bit hash of the text, which stands for the class in the anchors.
    """
    long = _ready(docs).filter(F.char_length("text") >= shortest).select("doc_id", F.xxhash64("text").alias("code"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    first = long.groupBy("digest").agg(F.min("doc_id").alias("cls"))
    return long.join(first, "digest").select("doc_id", "cls", "code")


class _Search:
    """Anchors of the texts and what they match."""

    def __init__(self, docs: DataFrame, shortest: int):
        self.shortest, self.first = shortest, _ready(docs).filter(F.char_length("text") >= shortest)
        total = self.first.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
        period, cover = cover_for(shortest)
        self.buckets = buckets = max(24, math.ceil(total * len(cover) / period / ANCHORS_A_BUCKET))
        self.coded = self.first.select(F.xxhash64("text").alias("code"), "text")
        crowd = CROWD
        cells = self.coded.mapInArrow(lambda x: _anchors(x, shortest, buckets, max(2, crowd + 1)), _CELLS)
        found = checkpointed(cells.groupBy("bucket").applyInArrow(lambda t: _match(t, crowd), "a long, b long, shift long").distinct())
        self.matches = found.filter("b IS NOT NULL")
        self.crowds = found.filter("b IS NULL").select("a")
        self.crowded = self.crowds.count()

    def looking(self, what: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
        """Cells of the windows around crowded anchors, in one more pass over the texts: with the anchors in hand where they are few, else
        with the places of each text, found by a join on the hash."""
        shortest, buckets = self.shortest, self.buckets
        if self.crowded <= CROWDED_AT_ONCE:
            some = np.sort(np.array([r.a for r in self.crowds.collect()], dtype=np.uint64))
            return self.coded.mapInArrow(lambda x: what(x, shortest, buckets, some), _CELLS)
        places = self.coded.mapInArrow(lambda x: _listed(x, shortest), "code long, hash long, at long").join(self.crowds.withColumnRenamed("a", "hash"), "hash", "left_semi")
        packed = places.groupBy("code").applyInArrow(_packed_places, "code long, places array<binary>")
        return self.coded.join(packed, "code").select("code", "text", "places").mapInArrow(lambda x: what(x, shortest, buckets, None), _CELLS)


def _listed(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """The anchors of each text, one by one."""
    for cls, text, _ in _texts(batches):
        of, at, h = _places(text, shortest)
        yield pa.RecordBatch.from_arrays([pa.array(cls[of]), pa.array((h >> SHIFT).astype(np.int64)), pa.array(at)], names=["code", "hash", "at"])


def _packed_places(table: pa.Table) -> pa.Table:
    return pa.table({"code": table["code"][:1], "places": pa.array([[pack_ints(np.unique(table["at"].to_numpy()))]], pa.list_(pa.binary()))})


def _runs(search: _Search, matches: DataFrame, classes: DataFrame, every: bool) -> DataFrame:
    """The shared runs of matched classes, ``a, b, start_a, start_b, length``, a < b."""
    reps = classes.filter("doc_id = cls").select("code", "cls")
    x, y = (reps.toDF(s, f"cls_{s}") for s in "ab")
    named = matches.join(x, "a").join(y, "b")
    pairs = checkpointed(named.groupBy("cls_a", "cls_b").agg(F.collect_set("shift").alias("shifts"), F.max(F.col("shift").isNull()).alias("whole")))
    ends = checkpointed(pairs.select(F.col("cls_a").alias("doc_id")).union(pairs.select("cls_b")).distinct())
    if ends.count() <= BROADCAST_IDS:
        ends = F.broadcast(ends)  # then only the texts of pairs are shuffled
    texts = search.first.join(ends, "doc_id", "left_semi")
    x, y = (texts.select(F.col("doc_id").alias(f"cls_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    both = pairs.join(x, "cls_a").join(y, "cls_b").select("cls_a", "cls_b", "shifts", "whole", "text_a", "text_b")
    shortest = search.shortest
    runs = both.mapInArrow(lambda t: _extend(t, shortest, every), "a long, b long, start_a long, start_b long, length long")
    swap = F.col("a") > F.col("b")
    turned = [F.when(swap, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("start_a", "start_b"), ("start_b", "start_a"))]
    return runs.select(*turned, "length")


def class_spans(docs: DataFrame, classes: DataFrame, shortest: int = SHORTEST, every: bool = False) -> DataFrame:
    """``a, b, start_a, start_b, length``: the longest runs that the texts of two classes share; a < b.

    With every each run comes out whole. Without it, texts with windows in many places or at many shifts give runs that
    may be cut, but cover the same characters; that is enough to tell pairs and keeps the rows few.
    classes as text_classes gives it, checkpointed. Positions and lengths are in code points from 0.
    """
    search = _Search(docs, shortest)
    matches = search.matches
    if search.crowded:  # a preamble just too short would give pairs without a run: look at the full length
        full = search.looking(_full_windows).groupBy("bucket").applyInArrow(lambda t: _match(t, None), "a long, b long, shift long")
        matches = matches.union(full).distinct()
    return _runs(search, matches, classes, every)


def shared_pairs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_a, doc_b``, doc_a < doc_b: documents that share a run of at least ``shortest`` characters.

    docs: ``doc_id bigint`` (unique; null rows are left out), ``text string``; other columns are ignored. Null, empty and
    shorter texts share nothing. Equal texts of the least length share all of theirs. Texts are compared as stored.
    """
    classes = checkpointed(text_classes(docs, shortest))
    links = class_spans(docs, classes, shortest).select("a", "b").distinct()
    x, y = (classes.select(F.col("cls").alias(f"cls_{s}"), F.col("doc_id").alias(f"doc_{s}")) for s in "xy")
    across = links.join(x, F.col("a") == F.col("cls_x")).join(y, F.col("b") == F.col("cls_y")).select("doc_x", "doc_y")
    many = classes.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").select("cls")
    copies = classes.join(many, "cls").select("cls", "doc_id")
    x, y = (copies.select(F.col("cls").alias(f"cls_{s}"), F.col("doc_id").alias(f"doc_{s}")) for s in "xy")
    within = x.join(y, (F.col("cls_x") == F.col("cls_y")) & (F.col("doc_x") < F.col("doc_y"))).select("doc_x", "doc_y")
    return across.union(within).select(F.least("doc_x", "doc_y").alias("doc_a"), F.greatest("doc_x", "doc_y").alias("doc_b"))


def coverage(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, chars, shared_chars, shared_runs``: how much of each text lies in runs that occur in another document.

    One row for each document with a doc_id; null and empty texts have 0. Overlapping runs count once. Passages in more than CROWD
    places make no pairs.
    """
    classes = checkpointed(text_classes(docs, shortest))
    search = _Search(docs, shortest)
    runs = _runs(search, search.matches, classes, False)
    ends = runs.select(F.col("a").alias("cls"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e"))
    ends = ends.union(runs.select("b", "start_b", F.col("start_b") + F.col("length")))
    if search.crowded:
        windows = search.looking(_windows).groupBy("bucket").applyInArrow(_shared, "code long, starts binary")
        stretches = windows.groupBy("code").applyInArrow(lambda t: _joined_up(t, shortest), "code long, s long, e long")
        ends = ends.union(stretches.join(classes.filter("doc_id = cls").select("code", "cls"), "code").select("cls", "s", "e"))
    ends = ends.distinct()
    w = Window.partitionBy("cls").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = ends.withColumn("reach", reach).withColumn("from", F.greatest("s", F.coalesce("reach", "s")))
    parts = parts.groupBy("cls").agg(F.sum(F.greatest(F.col("e") - F.col("from"), F.lit(0))).alias("covered"), F.sum(F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), 1).otherwise(0)).alias("runs"))
    sizes = classes.groupBy("cls").agg(F.count("*").alias("n"))
    by_doc = classes.join(sizes, "cls").join(parts, "cls", "left")
    all_docs = _ready(docs).select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"))
    out = all_docs.join(by_doc, "doc_id", "left")
    copy = F.col("n") > 1
    return out.select("doc_id", "chars", F.when(copy, F.col("chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"), F.when(copy, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("shared_runs"))
