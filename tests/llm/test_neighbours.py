import random

import numpy as np
import pytest

from pixelsieve.llm import neighbours as N


def rows_of(seed, clusters=40, size=8, nbytes=64, flips=50):
    r = random.Random(seed)
    out = []
    for _ in range(clusters):
        base = int.from_bytes(r.randbytes(nbytes))
        for _ in range(size):
            x = base
            for _ in range(r.randrange(flips)):
                x ^= 1 << r.randrange(nbytes * 8)
            out.append(x.to_bytes(nbytes))
    return [(i * 3 + 1, b) for i, b in enumerate(out)]


def brute_force(rows, queries, nbits, k=5):
    """The same by measuring every pair."""
    have = {i: int.from_bytes(b) for i, b in rows if i is not None and b is not None and len(b) == nbits // 8}
    return {(q, i) for q in set(queries) if q in have for _, i in sorted(((have[q] ^ b).bit_count(), i) for i, b in have.items() if i != q)[:k]}


def run(spark, rows, queries, nbits=512, **kw):
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), "x") for i, b in rows], "id long, bits binary, distance string")
    got = N.nearest(df, spark.createDataFrame([(q,) for q in queries], "id long"), nbits, **kw).collect()
    pairs = [(r.id, r.near_id) for r in got]
    assert len(pairs) == len(set(pairs))
    have = dict(rows)
    for r in got:
        assert r.distance == (int.from_bytes(have[r.id]) ^ int.from_bytes(have[r.near_id])).bit_count()
    return set(pairs)


@pytest.mark.parametrize("nbytes", [64, 32])
def test_recall_against_brute_force(spark, nbytes):
    rows = rows_of(1, nbytes=nbytes, flips=nbytes // 2)
    queries = [i for i, _ in rows[::3]]
    want = brute_force(rows, queries, nbytes * 8)
    assert len(want & run(spark, rows, queries, nbytes * 8)) >= 0.95 * len(want)


def test_all_lists_find_random_vectors_too(spark):
    r = random.Random(2)
    rows = [(i, r.randbytes(64)) for i in range(800)]
    queries = list(range(0, 800, 50))
    want = brute_force(rows, queries, 512)
    assert len(want & run(spark, rows, queries, exhaustive=True)) >= 0.95 * len(want)


@pytest.mark.parametrize("exhaustive", [True, False])
def test_parts_are_split_by_measured_size(spark, monkeypatch, exhaustive):
    monkeypatch.setattr(N, "ROWS_A_CELL", 30)
    rows = rows_of(3)
    queries = [i for i, _ in rows]
    want = brute_force(rows, queries, 512)
    assert len(want & run(spark, rows, queries, exhaustive=exhaustive)) >= 0.95 * len(want)


@pytest.mark.parametrize("nbits", [256, 512])
def test_plans_keep_the_chance_and_scan_ever_less(nbits):
    shares = []
    for n in (10**e for e in range(4, 13)):
        p = N.plan_lists(n, nbits)
        assert 1 - (1 - N.meets(p.k, p.parts, p.flips, p.part_flips, N.FAR)) ** p.tables >= N.RECALL
        assert n / 2**p.k < 2 * N.ROWS_A_LIST
        shares.append(N.meets(p.k, p.parts, p.flips, p.part_flips, 0.5))
    assert shares[-1] < shares[4] < shares[0] and max(shares[3:]) < 0.02


def test_limits_are_quantiles():
    limits = N._limits(256, 0.01)
    r = np.random.default_rng(1)
    for bound in (0, 3, 40, 120):
        x = np.zeros(256, bool)
        x[:bound] = True
        near = np.array([r.permutation(x) for _ in range(4000)])
        for b in range(4):
            d = near[:, : 64 * (b + 1)].sum(axis=1)
            assert (d > limits[b, bound]).mean() < 0.02
            assert limits[b, bound] == 0 or (d >= limits[b, bound]).mean() > 0.005
    assert (N._limits(256, 0.0)[:, 40] == 40).all()


def test_most_candidates_are_abandoned_early(spark):
    rows = rows_of(8, 100, 8, flips=60)
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, bits binary")
    work = {r.block: r.pairs for r in N.scan_work(df, df.filter("id % 7 = 1").select("id"), 512).collect()}
    assert sorted(work) == list(range(9)) and all(work[b] >= work[b + 1] for b in range(8))
    assert work[8] < 0.5 * work[0]


def test_a_third_of_equal_vectors_and_ties(spark):
    rows = rows_of(4, 20, 6)
    rows += [(10_000 + i, rows[0][1]) for i in range(len(rows) // 2)]
    queries = [rows[0][0], 10_000, 10_001, rows[50][0]]
    assert run(spark, rows, queries, exhaustive=True) == brute_force(rows, queries, 512)


def test_missing_repeated_and_unknown(spark):
    rows = rows_of(5, 4, 4) + [(9001, None), (9002, b""), (9003, b"short"), (None, b"\1" * 64)]
    queries = [rows[0][0], rows[0][0], 9001, 9002, 77_777, None]
    assert run(spark, rows, queries) == brute_force(rows, queries, 512)


def test_few_or_no_rows(spark):
    assert run(spark, [], [1]) == set()
    assert run(spark, [(1, b"\0" * 64)], [1]) == set()
    assert run(spark, [(1, b"\0" * 64), (2, b"\1" * 64)], [1]) == {(1, 2)}
    assert run(spark, [(1, b"\0" * 64)], []) == set()


def copies(seed, hot, total):
    """hot equal rows, mixed with groups of 8 equal rows."""
    r = random.Random(seed)
    out = [r.randbytes(64)] * hot
    while len(out) < total:
        out += [r.randbytes(64)] * 8
    first = out[0]
    r.shuffle(out)
    return list(enumerate(out[:total])), [i for i, b in enumerate(out[:total]) if b == first]


@pytest.mark.parametrize("seed, hot, total", [(0, 20, 1200), (1, 20, 1200), (0, 2800, 4096), (3, 4096, 12_288)])
@pytest.mark.parametrize("low_bits", [0, 3])
def test_equal_vectors_in_one_list(seed, hot, total, low_bits):
    rows, same = copies(seed, hot, total)
    queries = sorted({same[0], *range(0, total, 3 * total // 1200)})
    bits = np.array([list(b) for _, b in rows], dtype=np.uint8)
    ids, qid = np.arange(total), np.array(queries)
    low = N._values(bits, np.arange(low_bits))
    lists = N._Lists(bits, ids, low, low_bits, N.ALPHA)
    words = np.ascontiguousarray(N.words64(bits[qid]).T)
    best = N._Best(np.full(len(qid), 513), 5)
    for flips in range(low_bits + 1):
        if low_bits:
            lists.probe(best, words, qid, np.arange(len(qid)), low[qid], flips)
        else:
            lists.all(best, words, qid)
        best.settle()
    q, _, near = best.found
    got, want = set(zip(qid[q].tolist(), near.tolist())), brute_force(rows, queries, 512)
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)
    equal = {(q, i) for q, i in want if rows[q][1] == rows[i][1]}
    assert equal <= got


def test_of_equal_rows_the_smallest_ids_stay():
    rows = np.repeat(np.arange(64, dtype=np.uint8).reshape(8, 8), [1, 5, 2, 9, 1, 1, 3, 4], axis=0)
    ids = np.random.default_rng(1).permutation(len(rows))
    few = N._few_equal(ids, rows, 3)
    want = {i for b in {x.tobytes() for x in rows} for i in sorted(i for i, x in zip(ids.tolist(), rows) if x.tobytes() == b)[:3]}
    assert set(ids[few].tolist()) == want


def test_a_third_of_equal_vectors_in_the_nearest_lists(spark):
    rows, same = copies(6, 1400, 4000)
    queries = same[:20] + list(range(0, 4000, 40))
    assert run(spark, rows, queries) == brute_force(rows, queries, 512)


def test_waiting_candidates_are_cut(monkeypatch):
    monkeypatch.setattr(N, "WAITING", 10)
    best = N._Best(np.full(1, 513), 2)
    for i in range(30):
        best.add(np.zeros(4, np.int64), np.full(4, 30 - i), np.arange(4) + 4 * i)
        assert sum(len(x[0]) for x in best.new) <= 10
    best.settle()
    assert best.found[2].tolist() == [116, 117]
