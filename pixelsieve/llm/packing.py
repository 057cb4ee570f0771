"""Filling containers of fixed capacity with items of varying size (problem 8).

A grouping genetic algorithm: an individual is a division of the items into containers. Crossover puts whole
well-filled containers of one parent into the other, takes out the containers that repeat an item (removing
duplicates), and places the displaced items; mutation empties a few containers and places what was in them. Displaced items
first replace smaller ones wherever that leaves a container fuller, and what is then displaced goes by best fit, largest first.

The population starts from best fit by falling size over all items: counts by size, of which there are at most CLASSES for
a capacity however many items there are, are all it takes to say which rank of which size goes where. Its containers are
dealt over shards, so that every shard begins with its part of that division and others of its own. ISLANDS populations evolve each
shard apart and send their elite to the next island between EPOCHS, each until it needs no more containers than a lower bound says
or its GENERATIONS are over. The best of a population is never lost, so the result never takes more containers than best fit
over everything. At the end the worst-filled containers of MERGE shards are filled once more, if that takes fewer.

An item larger than the capacity is cut into full containers and a rest, which is an item like others; nothing else is
cut. All sizes are integers, every item is placed once, and a container's sum never exceeds the capacity.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, pack_ints, run_starts, unpack_ints

ISLANDS, POPULATION, EPOCHS, GENERATIONS = 3, 4, 3, 15
SHARD_ITEMS = 2_500
ISLANDS_A_TASK = 8
MERGE = 32
#: Containers emptier than this share are opened at the end.
OPEN_BELOW = 0.95
#: Sizes of larger capacities are rounded up to one of so many classes for the start.
CLASSES = 65_536
#: Free items that may replace others in one round, the best replacements that are tried in it, and rounds.
CONSIDERED, REPLACEMENTS, ROUNDS = 12, 200, 4
#: Couples of items that are looked at together.
COUPLES = 8_192
#: Of one class so many items are ranked in one task.
ITEMS_A_RANKING = 1_000_000
#: Classes of the capacities worked off together.
CLASSES_AT_ONCE = 4 * CLASSES


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray, fill: list[int]) -> None:
    """Places the items ``order``, in that order, each into the fullest container that still takes it; extends fill."""
    room = sorted((capacity - f, b) for b, f in enumerate(fill))
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        fill[b] += s
        bins[i] = b
        insort(room, (left - s, b))


def best_fit_of_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit by falling size of so many items of each size, none 0: (size, first rank, first container, items a container)
    for runs of equal items, and the number of containers.

    Containers of equal room are kept as ranges. Of equal items the fullest container that takes one takes as many as it can.
    """
    room: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    slots, bins = [], 0

    def keep(left: int, first: int, n: int) -> None:
        if n:
            if left not in ranges:
                ranges[left] = []
                insort(room, left)
            ranges[left].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, todo = 0, counts[size]
        while todo:
            at = bisect_left(room, size)
            if at < len(room):
                left = room[at]
                first, n = ranges[left].pop()
                if not ranges[left]:
                    del ranges[left]
                    room.pop(at)
            else:
                left, first, n = capacity, bins, -(-todo // (capacity // size))
                bins += n
            each = left // size
            full = min(n, todo // each)
            rest = todo - full * each if full < n else 0
            if full:
                slots.append((size, rank, first, each))
            if rest:
                slots.append((size, rank + full * each, first + full, rest))
            keep(left - each * size, first, full)
            keep(left - rest * size, first + full, int(rest > 0))
            keep(left, first + full + (rest > 0), n - full - (rest > 0))
            rank, todo = rank + full * each + rest, todo - full * each - rest
    return slots, bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any division needs (the bound of Martello and Toth)."""
    s = np.sort(sizes)
    total = np.r_[0, np.cumsum(s)]
    half = np.searchsorted(s, capacity // 2, "right")  # items up to it are small
    k = np.unique(np.r_[0, s[:half]])
    small = np.searchsorted(s, k, "left")
    large = np.searchsorted(s, capacity - k, "right")  # from there on nothing of size k fits beside
    room = (large - half) * capacity - (total[large] - total[half])
    more = np.maximum(0, -(-(total[half] - total[small] - room) // capacity))
    return int((len(s) - half + more).max(initial=0))


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Few containers are better, then unevenly filled ones: smaller is better."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return len(fill), -float((fill**2).sum())


def _couples(order: np.ndarray, bins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every two items of one container, for items in the order of their containers; in blocks of about COUPLES."""
    start, length = run_starts(bins[order])
    at = np.arange(len(order))
    n = np.repeat(start + length, length) - at - 1
    for s, m in zip(*run_starts((np.cumsum(n) - n) // COUPLES)):
        here, some = at[s : s + m], n[s : s + m]
        other = np.repeat(here, some) + 1 + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        yield order[np.repeat(here, some)], order[other]


def _leaving(sizes: np.ndarray, bins: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What may make way in a container: an item and -1, or two items. Items of one size in one container stand for each other."""
    placed = np.flatnonzero(bins >= 0)
    order = placed[np.lexsort((sizes[placed], bins[placed]))]
    new = np.r_[True, (np.diff(bins[order]) != 0) | (np.diff(sizes[order]) != 0)][: len(order)]
    once = order[new]
    for k in range(0, len(once), COUPLES):
        yield once[k : k + COUPLES], np.full(len(once[k : k + COUPLES]), -1)
    if len(order) <= 16 * len(room):  # couples of many small items are too many
        yield from _couples(order[new | np.r_[True, new[:-1]][: len(order)]], bins)


def replaced(sizes: np.ndarray, capacity: int, bins: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Puts one or two free items in the place of one or two smaller ones where that leaves a container fuller; returns
    the items that are free then. bins is -1 for free items."""
    for _ in range(ROUNDS):
        if not len(free):
            break
        free = free[np.argsort(-sizes[free], kind="stable")]
        some, rest = free[:CONSIDERED], free[CONSIDERED:]
        placed = bins >= 0
        room = capacity - np.bincount(bins[placed], weights=sizes[placed]).astype(np.int64)
        a, b = np.triu_indices(len(some), 1)
        in_first, in_second = np.r_[np.arange(len(some)), a], np.r_[np.full(len(some), -1), b]
        in_size = np.r_[sizes[some], sizes[some[a]] + sizes[some[b]]]
        by_size = np.argsort(in_size, kind="stable")
        best = np.empty((5, 0), dtype=np.int64)  # gain, room, the items that go, which come
        for first, second in _leaving(sizes, bins, room):
            left, out_size = room[bins[first]], sizes[first] + np.where(second < 0, 0, sizes[second])
            least = best[0].min() if best.shape[1] == REPLACEMENTS else 0
            start = np.searchsorted(in_size[by_size], out_size + least, "right")
            n = np.maximum(0, np.searchsorted(in_size[by_size], out_size + left, "right") - start)
            r = np.repeat(np.arange(len(n)), n)
            c = by_size[start[r] + np.arange(len(r)) - (np.cumsum(n) - n)[r]]
            gain = in_size[c] - out_size[r]
            if len(gain) > REPLACEMENTS:
                top = np.argpartition(-gain, REPLACEMENTS)[:REPLACEMENTS]
                r, c, gain = r[top], c[top], gain[top]
            best = np.concatenate([best, np.stack([gain, left[r], first[r], second[r], c])], axis=1)
            best = best[:, np.lexsort((best[1], -best[0]))[:REPLACEMENTS]]
        if not best.shape[1]:
            break
        taken, touched, gone = set(), set(), []
        for first, second, c, where in zip(*best[2:].tolist(), bins[best[2]].tolist()):
            put = [int(y) for y in (in_first[c], in_second[c]) if y >= 0]
            if where in touched or taken.intersection(put):
                continue
            touched.add(where)
            taken.update(put)
            for y in (first, second):
                if y >= 0:
                    bins[y] = -1
                    gone.append(y)
            bins[some[put]] = where
        free = np.r_[[y for k, y in enumerate(some.tolist()) if k not in taken], rest, gone].astype(np.int64)
    return free


def settled(sizes: np.ndarray, capacity: int, bins: np.ndarray) -> np.ndarray:
    """A whole division again: free items (-1) placed by replacement, then by best fit."""
    free = replaced(sizes, capacity, bins, np.flatnonzero(bins < 0))
    placed = np.flatnonzero(bins >= 0)
    names, bins[placed] = np.unique(bins[placed], return_inverse=True)
    fill = np.bincount(bins[placed], weights=sizes[placed], minlength=len(names)).astype(np.int64).tolist()
    best_fit(sizes, free[np.argsort(-sizes[free], kind="stable")], capacity, bins, fill)
    return bins


def started(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Best fit by falling size with some noise."""
    bins, fill = np.zeros(len(sizes), dtype=np.int64), []
    best_fit(sizes, np.argsort(-sizes * rng.uniform(0.8, 1.0, len(sizes)), kind="stable"), capacity, bins, fill)
    return bins


def crossed(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The taker with some well-filled containers of the giver."""
    fill = np.bincount(giver, weights=sizes)
    full = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[full[rng.random(len(full)) < rng.uniform(0.1, 0.6)]] = True
    injected = chosen[giver]
    gone = np.zeros(taker.max() + 1, dtype=bool)
    gone[taker[injected]] = True
    kept = ~injected & ~gone[taker]
    child = np.full(len(sizes), -1)
    child[injected] = giver[injected]
    child[kept] = taker[kept] + len(fill)
    return settled(sizes, capacity, child)


def mutated(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A few containers emptied, among them the emptiest, and their items placed again."""
    fill = np.bincount(bins, weights=sizes)
    n = min(len(fill), int(rng.integers(2, 6)))
    emptied = np.r_[np.argsort(fill, kind="stable")[: max(1, n // 2)], rng.choice(len(fill), n, replace=False)]
    return settled(sizes, capacity, np.where(np.isin(bins, emptied), -1, bins))


def evolved(sizes: np.ndarray, capacity: int, people: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
    """The best of the population and its children after some generations, best first."""
    bound = lower_bound(sizes, capacity)
    scored = sorted(((*fitness(sizes, b, capacity), k, b) for k, b in enumerate(people)), key=lambda x: x[:3])
    for g in range(GENERATIONS):
        if len(scored) < 2 or scored[0][0] <= bound:
            break
        i, j = sorted(rng.choice(len(scored), 2, replace=False))
        child = mutated(sizes, crossed(sizes, scored[i][3], scored[j][3], capacity, rng), capacity, rng)
        other = mutated(sizes, scored[0][3], capacity, rng)
        scored += [(*fitness(sizes, b, capacity), 1000 + 2 * g + k, b) for k, b in enumerate((child, other))]
        scored = sorted(scored, key=lambda x: x[:3])[:POPULATION]
    return [x[3] for x in scored[:POPULATION]]


_STATE = "cap_id long, capacity long, shard long, island int, ids binary, parts binary, sizes binary, people array<binary>, done boolean"
_SCHEMA = pa.schema([("cap_id", pa.int64()), ("capacity", pa.int64()), ("shard", pa.int64()), ("island", pa.int32()), ("ids", pa.binary()), ("parts", pa.binary()), ("sizes", pa.binary()), ("people", pa.list_(pa.binary())), ("done", pa.bool_())])


def _state(*rows: tuple) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def _gathered(table: pa.Table) -> pa.Table:
    """The items of a shard, and their part of the first division."""
    key = [table[x][0].as_py() for x in ("cap_id", "capacity", "shard")]
    ids, parts, sizes, bins = (table[x].to_numpy() for x in ("id", "part", "size", "bin"))
    at = np.lexsort((parts, ids))
    names, bins = np.unique(bins[at], return_inverse=True)
    sizes = sizes[at]
    return _state((*key, -1, pack_ints(ids[at]), pack_ints(parts[at]), pack_ints(sizes), [pack_ints(bins)], len(names) <= lower_bound(sizes, key[1])))


def _epoch(epoch: int) -> Callable[[pa.Table], pa.Table]:
    """An island's population and the elite that came to it; only the island's own row holds the items."""

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ids"] is None)
        own = rows[0]
        key, island, sizes = (own["cap_id"], own["capacity"], own["shard"]), own["island"], unpack_ints(own["sizes"])
        rng = np.random.default_rng([abs(key[0]), key[2], island, epoch])
        people = [unpack_ints(x) for r in rows for x in r["people"]]
        if epoch == 1:
            people += [started(sizes, key[1], rng) for _ in range(POPULATION - 1)]
        people = [pack_ints(b) for b in evolved(sizes, key[1], people, rng)]
        if epoch == EPOCHS:
            return _state((*key, island, own["ids"], own["parts"], own["sizes"], people[:1], True))
        elite = (*key, (island + 1) % ISLANDS, None, None, None, people[:1], False)
        return _state((*key, island, own["ids"], own["parts"], own["sizes"], people, False), *[elite] * (ISLANDS > 1))

    return work


def _finish(table: pa.Table) -> pa.Table:
    """The best island of each shard; the emptiest containers of all shards here are filled once more."""
    cap_id, capacity = table["cap_id"][0].as_py(), table["capacity"][0].as_py()
    best: dict[int, tuple] = {}
    for r in table.to_pylist():
        sizes, bins = unpack_ints(r["sizes"]), unpack_ints(r["people"][0])
        score = (*fitness(sizes, bins, capacity), r["island"])
        if r["shard"] not in best or score < best[r["shard"]][0]:
            best[r["shard"]] = (score, unpack_ints(r["ids"]), unpack_ints(r["parts"]), sizes, bins)
    shards = [v for _, v in sorted(best.items())]
    offset = np.cumsum([0] + [v[4].max() + 1 for v in shards])
    ids, parts, sizes = (np.concatenate([v[k] for v in shards]) for k in (1, 2, 3))
    bins = np.concatenate([v[4] + o for v, o in zip(shards, offset)])
    opened = (np.bincount(bins, weights=sizes) < OPEN_BELOW * capacity)[bins]
    if opened.any():
        again, more = np.zeros(len(ids), dtype=np.int64), []
        loose = np.flatnonzero(opened)
        best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], capacity, again, more)
        if len(more) < len(np.unique(bins[opened])):
            bins = np.where(opened, again + offset[-1], bins)
    names = np.unique(bins, return_inverse=True)[1]
    n, group = len(ids), table["shard"][0].as_py() // MERGE
    return pa.table({"cap_id": np.full(n, cap_id), "id": ids, "part": parts, "size": sizes, "group": np.full(n, group), "bin": names})


class _Start:
    """Best fit of all items for one capacity, by ranks within the classes of sizes."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.unit = -(-capacity // CLASSES)
        slots, self.bins = best_fit_of_counts(counts, capacity // self.unit)
        slots = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)
        self.key, (_, self.rank, self.first, self.each) = (slots[:, 0] << 40) + slots[:, 1], slots.T
        self.shards = max(1, min(self.bins, round(sum(counts.values()) / SHARD_ITEMS)))
        self.groups = -(-self.shards // MERGE)

    def container(self, cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, (cls << 40) + rank, "right") - 1
        return self.first[at] + (rank - self.rank[at]) // self.each[at]


def _placed(batches: Iterator[pa.RecordBatch], starts: dict[int, _Start]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cap, cls, rank = (batch.column(i).to_numpy() for i in (0, 5, 6))
        bins, shard = np.zeros(len(cap), dtype=np.int64), np.zeros(len(cap), dtype=np.int64)
        for c in np.unique(cap):
            at = np.flatnonzero(cap == c)
            bins[at] = starts[c].container(cls[at], rank[at])
            shard[at] = bins[at] % starts[c].shards
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(shard), pa.array(bins)], names=["cap_id", "capacity", "id", "part", "size", "shard", "bin"])


def _sized(items: DataFrame) -> DataFrame:
    return items.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("size"))


def _capacities(capacities: DataFrame) -> list[list[tuple[int, int]]]:
    """The settings, in blocks that share their work."""
    rows = capacities.select(F.col("cap_id").cast("long"), F.col("capacity").cast("long")).filter("cap_id IS NOT NULL AND capacity > 0").distinct()
    blocks: list[list[tuple[int, int]]] = []
    room = 0
    for cap in sorted({(r[0], r[1]) for r in rows.collect()}):
        room -= min(cap[1], CLASSES)
        if room < 0 or len(blocks[-1]) == 500 or any(c == cap[0] for c, _ in blocks[-1]):
            blocks.append([])
            room = CLASSES_AT_ONCE - min(cap[1], CLASSES)
        blocks[-1].append(cap)
    return blocks


def _each(items: DataFrame, caps: list[tuple[int, int]]) -> DataFrame:
    """Items for each capacity: ``cap_id, capacity, id, whole, size, cls``, whole the full containers that it takes, size the rest."""
    settings = F.array(*[F.struct(F.lit(c).cast("long").alias("cap_id"), F.lit(cap).cast("long").alias("capacity")) for c, cap in caps])
    each = items.select("id", "size", F.explode(settings).alias("c")).select("c.*", "id", "size")
    whole = F.when(F.col("size") > F.col("capacity"), F.expr("size div capacity")).otherwise(F.lit(0).cast("long"))
    each = each.withColumn("whole", whole).withColumn("size", F.expr("size - whole * capacity"))
    unit = F.expr(f"(capacity + {CLASSES - 1}) div {CLASSES}")
    return each.withColumn("unit", unit).withColumn("cls", F.expr("least((size + unit - 1) div unit, capacity div unit)")).drop("unit")


def _starts(each: DataFrame, caps: list[tuple[int, int]]) -> dict[int, _Start]:
    counts: dict[int, dict[int, int]] = {c: {} for c, _ in caps}
    for r in each.filter("size > 0").groupBy("cap_id", "cls").count().collect():  # at most CLASSES a capacity, however many items
        counts[r[0]][r[1]] = r[2]
    return {c: _Start(counts[c], cap) for c, cap in caps}


def _ranked(loose: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, 0, 1, ... within cap_id and cls. A class that many items share is ranked in salted pieces."""
    salts = max(1, math.ceil(total / ITEMS_A_RANKING))
    salted = loose.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("cap_id", "cls", "salt").orderBy("id", "part")).cast("long") - 1
    ranked = salted.withColumn("rank", rank)
    if salts > 1:
        before = F.coalesce(F.sum("n").over(Window.partitionBy("cap_id", "cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = salted.groupBy("cap_id", "cls", "salt").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
        ranked = ranked.join(sizes, ["cap_id", "cls", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("cap_id", "capacity", "id", "part", "size", "cls", "rank")


def _packed(items: DataFrame, total: int, caps: list[tuple[int, int]]) -> DataFrame:
    each = _each(items, caps)
    starts = _starts(each, caps)
    full = each.filter("whole > 0").select("cap_id", "capacity", "id", F.explode(F.expr("sequence(0L, whole - 1)")).alias("part"))
    full = full.select("cap_id", "capacity", "id", "part", F.col("capacity").alias("size"), F.concat_ws("-", F.lit("full"), "id", "part").alias("container"))
    groups = F.element_at(F.create_map(*[F.lit(x).cast("long") for c, _ in caps for x in (c, starts[c].groups)]), F.col("cap_id"))
    # any container takes an item of size 0: the first of a group, so that no task has to hold them
    none = each.filter("size = 0 AND whole = 0").select("cap_id", "capacity", "id", F.lit(0).cast("long").alias("part"), "size", F.concat_ws("-", F.pmod(F.xxhash64("id"), groups), F.lit(0)).alias("container"))
    loose = _ranked(each.filter("size > 0").select("cap_id", "capacity", "id", F.col("whole").alias("part"), "size", "cls"), total)
    placed = loose.mapInArrow(lambda x: _placed(x, starts), "cap_id long, capacity long, id long, part long, size long, shard long, bin long")
    shards = checkpointed(placed.groupBy("cap_id", "shard").applyInArrow(_gathered, _STATE))
    state = shards.filter("NOT done").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    # few bytes but much work: a stated number of partitions isn't coalesced by size, and all epochs share it
    tasks = max(12, math.ceil(sum(s.shards for s in starts.values()) * ISLANDS / ISLANDS_A_TASK))
    for epoch in range(1, EPOCHS + 1):
        state = state.repartition(tasks, "cap_id", "shard", "island")
        state = state.groupBy("cap_id", "shard", "island").applyInArrow(_epoch(epoch), _STATE)
    whole = shards.filter("done").unionByName(state)
    merged = whole.withColumn("group", F.expr(f"shard div {MERGE}")).groupBy("cap_id", "group").applyInArrow(_finish, "cap_id long, id long, part long, size long, `group` long, bin long")
    capacity_of = F.element_at(F.create_map(*[F.lit(x).cast("long") for c in caps for x in c]), F.col("cap_id"))
    rest = merged.select("cap_id", capacity_of.alias("capacity"), "id", "part", "size", F.concat_ws("-", "group", "bin").alias("container"))
    return reduce(DataFrame.unionByName, (rest, full, none))


_RESULT = "cap_id long, capacity long, id long, part long, start long, size long, container string"


def pack(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """``cap_id, capacity, id, part, start, size, container``: where each item, or part of one, goes for each capacity.

    items: ``id bigint`` (unique), ``size`` (integer); capacities: ``cap_id``, ``capacity`` (positive; a table of settings, which the
    driver reads and works off in blocks). A null or negative size counts as 0; items of size 0 take a place in some
    container too. Rows with a null id, cap_id or capacity, or a capacity below 1, are left out; repeated capacities
    count once. ``container`` is unique within cap_id and capacity. No items give no rows. Only an item larger than the capacity
    has several parts, at ``start`` 0, capacity, 2 * capacity and so on.
    """
    blocks = _capacities(capacities)
    spark = items.sparkSession
    if not blocks:
        return spark.createDataFrame([], _RESULT)
    items = checkpointed(_sized(items))  # sizes are costly and read several times
    total = items.count()
    if not total:
        return spark.createDataFrame([], _RESULT)
    out = reduce(DataFrame.unionByName, [_packed(items, total, caps) for caps in blocks])
    return out.select("cap_id", "capacity", "id", "part", (F.col("part") * F.col("capacity")).alias("start"), "size", "container")


def best_fit_alone(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """``cap_id, capacity, best_fit, least``: containers that best fit by falling size over all items takes, and the least
    number that the sum of sizes allows; full containers of larger items included."""
    items, rows = checkpointed(_sized(items)), []
    for caps in _capacities(capacities):
        each = _each(items, caps)
        starts = _starts(each, caps)
        sums = {r[0]: r for r in each.groupBy("cap_id").agg(F.sum("whole"), F.sum("size")).collect()}
        rows += [(c, cap, int(sums[c][1]) + starts[c].bins, int(sums[c][1]) + -(-int(sums[c][2]) // cap)) for c, cap in caps if c in sums]
    return items.sparkSession.createDataFrame(rows, "cap_id long, capacity long, best_fit long, least long")
