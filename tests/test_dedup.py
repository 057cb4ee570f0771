import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelsieve.operators import dedup, graph, matrix_join, setops
from pixelsieve.schema import DHASH, HashSpec

SPEC = HashSpec("h", 64, 8)


def hashes(n, seed=0, near=0.5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < near:
            x = int.from_bytes(r.choice(out))
            for _ in range(r.randrange(12)):
                x ^= 1 << r.randrange(64)
            out.append(x.to_bytes(8))
        else:
            out.append(r.randbytes(8))
    return out


def frame(spark, values, start=0):
    return spark.createDataFrame([(start + i, f"p{start + i}", None if v is None else bytearray(v)) for i, v in enumerate(values)], "idx long, path string, h binary")


def apart(a, b):
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def brute(values, below=8):
    return {(i, j, d) for i in range(len(values)) for j in range(i) if values[i] and values[j] and len(values[i]) == len(values[j]) == 8 and (d := apart(values[i], values[j])) < below}


@pytest.mark.parametrize("strategy", ["broadcast", "blocked", "banded", "matrix", None])
def test_pairs_by_every_strategy(spark, strategy, monkeypatch):
    monkeypatch.setattr(dedup, "ROWS_A_BLOCK", 40)
    monkeypatch.setattr(matrix_join, "ROWS_A_BLOCK", 20)
    values = hashes(150) + [None, b"", b"short", hashes(1)[0]]
    got = [(r.i, r.j, r["diff"]) for r in dedup.near_pairs(frame(spark, values), SPEC, strategy=strategy).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(values)


def test_no_or_one_row_gives_no_pairs(spark):
    for n in (0, 1):
        assert dedup.near_pairs(frame(spark, hashes(n)), SPEC).count() == 0


def test_threshold_is_strict(spark):
    a, b, c = (0).to_bytes(8), (0xFF).to_bytes(8), (0x7F).to_bytes(8)
    assert {(r.i, r.j) for r in dedup.near_pairs(frame(spark, [a, b, c]), SPEC).collect()} == {(2, 0), (2, 1)}


def test_keep_first(spark):
    rows = frame(spark, [b"x" * 8, b"y" * 8, b"x" * 8, None, b"x" * 8])
    assert sorted(r.idx for r in dedup.keep_first(rows.orderBy("idx", ascending=False), "h").collect()) == [0, 1]


def test_missing_hash(spark):
    rows = frame(spark, [b"x" * 8, None, b"y"])
    assert sorted(r.idx for r in dedup.missing_hash(rows, SPEC).collect()) == [1, 2]


@pytest.mark.parametrize("limit", [10**6, 3])
def test_remain(spark, monkeypatch, limit):
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(matrix_join, "ROWS_A_BLOCK", 20)
    monkeypatch.setattr(matrix_join, "CHUNK_B", 7)
    values = hashes(120, 4)
    src, gal = values[:60] + [None], values[60:]
    got = sorted(r.idx for r in setops.remain(frame(spark, src), frame(spark, gal), SPEC).collect())
    assert got == [i for i, v in enumerate(src) if v and all(apart(v, g) >= 8 for g in gal)]


def test_remain_of_itself_and_of_nothing(spark):
    rows = frame(spark, hashes(20, 5))
    assert setops.remain(rows, rows, SPEC).count() == 0
    assert setops.remain(rows, rows.limit(0), SPEC).count() == 20


def test_merge_is_a_left_fold(spark):
    a, b, c = (0).to_bytes(8), (0x3F).to_bytes(8), (0xFFF).to_bytes(8)
    parts = [frame(spark, [x], i) for i, x in enumerate((a, b, c))]
    assert sorted(r.idx for r in setops.merge(parts, SPEC).collect()) == [0, 2]
    twice = frame(spark, [a, a])
    assert setops.merge([twice], SPEC).count() == 2


def test_cover_on_known_graphs():
    assert graph.cover([]) == []
    assert graph.cover([(1, 0)]) == [1]
    assert graph.cover([(1, 0), (2, 1)]) == [1]
    assert graph.cover([(i, 0) for i in range(1, 5)]) == [0]
    assert sorted(graph.cover([(1, 0), (2, 1), (3, 1), (5, 4)])) == [1, 5]
    assert sorted(graph.cover([(1, 0), (2, 1), (2, 0)])) == [1, 2]


def plain_cover(edges):
    left, gone = {frozenset(e) for e in edges if len(set(e)) == 2}, set()
    while left:
        degree = {}
        for e in left:
            for v in e:
                degree[v] = degree.get(v, 0) + 1
        v = max(degree, key=lambda x: (degree[x], x))
        gone.add(v)
        left = {e for e in left if v not in e}
    return gone


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=40))
def test_cover_is_the_plain_greedy_one(edges):
    gone = graph.cover(edges)
    assert set(gone) == plain_cover(edges)
    assert all(a == b or a in gone or b in gone for a, b in edges)


@pytest.mark.parametrize("together, rounds", [(0, 60), (0, 2), (0, 0), (40, 60), (10**6, 60)])
def test_greedy_removal(spark, monkeypatch, together, rounds):
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", together)
    monkeypatch.setattr(graph, "GREEDY_ROUNDS", rounds)
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(250)] + [(1000, i) for i in range(1001, 1040)] + [(2000 + i, 2001 + i) for i in range(12)] + [(5, 5)]
    got = {x.idx for x in graph.greedy_removal(spark.createDataFrame(edges, "i long, j long")).collect()}
    assert got == plain_cover(edges)


def test_greedy_removal_of_nothing(spark):
    assert graph.greedy_removal(spark.createDataFrame([], "i long, j long")).count() == 0


def test_labels_of_a_long_chain(spark):
    n = 60
    got = {r.v: r.label for r in graph.labels(spark.createDataFrame([(i, i + 1) for i in range(n)], "i long, j long")).collect()}
    assert got == {i: 0 for i in range(n + 1)}


def test_dedup_near(spark):
    values = hashes(100, 9)
    kept, pairs = setops.dedup_near(frame(spark, values), SPEC)
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(i, j, d) for i, j, d in brute(values) if first[values[i]] == i and first[values[j]] == j}
    assert {(r.i, r.j, r["diff"]) for r in pairs.collect()} == want and all(d > 0 for _, _, d in want)
    assert {r.idx for r in kept.collect()} == set(first.values()) - plain_cover([(i, j) for i, j, _ in want])


def test_plan_broadcasts_only_small_sides(spark, monkeypatch):
    assert dedup.strategy_for(10, DHASH.below) == "broadcast"
    assert dedup.strategy_for(10**7, DHASH.below) == "matrix"
    monkeypatch.setattr(dedup, "ROWS_A_BLOCK", 5)
    plan = dedup.near_pairs(frame(spark, hashes(40)), SPEC, strategy="blocked")._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
