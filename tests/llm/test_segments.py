import random

import numpy as np
import pytest

from pixelsieve.llm import segments as S
from pixelsieve.llm.common import joined_ints, pack_ints


def near(seed, n, flips, nbytes=64):
    r = random.Random(seed)
    out = [r.randbytes(nbytes)]
    while len(out) < n:
        x = int.from_bytes(r.choice(out) if r.random() < 0.5 else r.randbytes(nbytes))
        for k in r.sample(range(nbytes * 8), r.randrange(flips)):
            x ^= 1 << k
        if x.to_bytes(nbytes) not in out:
            out.append(x.to_bytes(nbytes))
    return out


def brute(values, sides, below):
    bits = [int.from_bytes(v) for v in values]
    return {(i, j) for j in range(len(bits)) for i in range(j) if (sides[i] | sides[j]) & 2 and (bits[i] ^ bits[j]).bit_count() < below}


def run(spark, values, sides, below, nbits=512, **kw):
    df = spark.createDataFrame([(i, bytearray(v), s) for i, (v, s) in enumerate(zip(values, sides))], "id long, bits binary, side int")
    got = S.near_bits(df, nbits, below, **kw).collect()
    pairs = [(r.a, r.b) for r in got]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


@pytest.mark.parametrize("limit", [10**6, 100, 20])
@pytest.mark.parametrize("exact", [False, True])
def test_pairs_by_bits(spark, monkeypatch, limit, exact):
    monkeypatch.setattr(S, "ROWS_A_BUCKET", limit)
    values = near(1, 500, 80)
    sides = [3] * len(values)
    assert run(spark, values, sides, 60, exact=exact) == brute(values, sides, 60)


@pytest.mark.parametrize("exact", [False, True])
def test_a_hot_list_in_small_cells(spark, monkeypatch, exact):
    """A third of the rows differ in one or two bits each from one another."""
    monkeypatch.setattr(S, "ROWS_A_BUCKET", 30)
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", 500)
    r = random.Random(4)
    base = int.from_bytes(r.randbytes(64))
    values = [(base ^ 1 << i).to_bytes(64) for i in range(0, 400, 4)] + [r.randbytes(64) for _ in range(200)]
    sides = [1 + 2 * (i % 5 != 0) for i in range(len(values))]
    assert run(spark, values, sides, 60, exact=exact) == brute(values, sides, 60)


@pytest.mark.parametrize("below, nbits", [(1, 64), (2, 64), (20, 64), (64, 64), (3, 128), (60, 256)])
def test_other_sizes(spark, below, nbits):
    values = near(below, 60, 30, nbits // 8)
    for exact in (False, True):
        assert run(spark, values, [3] * 60, below, nbits, exact=exact) == brute(values, [3] * 60, below)


def test_sides(spark):
    values = near(2, 300, 60)
    sides = [1 + 2 * (i % 3 == 0) for i in range(300)]
    want, got = brute(values, sides, 60), run(spark, values, sides, 60)
    assert got <= want and len(got) >= 0.995 * len(want)


def test_no_rows(spark):
    assert run(spark, [], [], 60) == set()
    assert run(spark, [b"\0" * 64], [3], 60) == set()


def test_expected_misses():
    for n in (100, 10**5, 10**7, 10**9):
        plan = S.plan_tables(n, 512, 60, miss=0.01)
        assert plan.parts < plan.k <= 40 and S.plan_tables(n, 512, 60).tables > plan.tables
        r = np.random.default_rng(n % 1000)
        at = S._positions(512, plan)
        hit = 0
        for _ in range(1000):
            flips = np.zeros(512, bool)
            flips[r.choice(512, 59, replace=False)] = True
            d = flips[at]
            hit += ((d[:, : plan.k].sum(axis=1) <= S.FLIPS) & ~d[:, : plan.parts].any(axis=1) & (d[:, plan.k :].sum(axis=1) <= plan.bound)).any()
        assert 970 <= hit <= 1000


def test_exact_tables_cover_every_position():
    plan = S.plan_tables(10**6, 512, 60, exact=True)
    own = [at[: int(S._value_mask(512, plan, t)).bit_count()] for t, at in enumerate(S._positions(512, plan))]
    assert sorted(np.concatenate(own).tolist()) == list(range(512))
    assert len(own) * (S.FLIPS + 1) > 59


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
def test_strings_exactly(spark, tau):
    r = random.Random(tau)
    out = {"", "a", "ab", "é", "日本語", "x" * 300, "x" * 303, "x" * 301 + "y", "\r", " "}
    while len(out) < 260:
        s = list(r.choice(sorted(out)) if r.random() < 0.6 else "/data/" + "".join(r.choice("abé") for _ in range(r.randrange(12))))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(s) + 1)
            kind = r.randrange(3)
            if kind == 0:
                s.insert(at, r.choice("abé/"))
            elif at < len(s):
                s[at : at + 1] = [] if kind == 1 else [r.choice("abé/")]
        out.add("".join(s))
    strings = sorted(out)
    sides = [r.choice([1, 3]) for _ in strings]
    df = spark.createDataFrame(list(zip(range(len(strings)), strings, sides)), "id long, s string, side int")
    got = [(x.a, x.b) for x in S.near_strings(df, tau).collect()]
    want = {(i, j) for j in range(len(strings)) for i in range(j) if (sides[i] | sides[j]) & 2 and abs(len(strings[i]) - len(strings[j])) <= tau and plain(strings[i], strings[j]) <= tau}
    assert len(got) == len(set(got)) and set(got) == want


def test_packed_numbers():
    for x in ([], [5], [-7, 2**40], [3, 2**31], [0, 2**62]):
        assert joined_ints([pack_ints(np.array(x, dtype=np.int64))]).tolist() == x
