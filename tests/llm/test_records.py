import random

import pytest

from pixelsieve.llm import history, near_records, seen
from pixelsieve.llm.components import components, links_of_pairs

SCHEMA = "idx long, keys string, v_dhash binary, extra int, bits int, rep string"



def brute_force(history: list[tuple], batches: list[tuple], below: int = 60) -> set[int]:
    """idx of the cases, batch by batch; history (idx, keys, hash), batches (batch_id, idx, keys, hash); for tests."""
    def bits(h):
        return int.from_bytes(h) if h is not None and len(h) == 64 else None

    known, cases = [(k, bits(h)) for _, k, h in history], set()
    once: dict[int, tuple] = {}
    for b, i, k, h in batches:
        if b is not None and i is not None and (i not in once or b < once[i][0]):
            once[i] = (b, k, bits(h))
    for batch in sorted({b for b, _, _ in once.values()}):
        taken = []
        for i, (b, k, h) in once.items():
            if b == batch:
                if any((k is not None and k == k2) or (h is not None and h2 is not None and (h ^ h2).bit_count() < below) for k2, h2 in known):
                    cases.add(i)
                else:
                    taken.append((k, h))
        known += taken
    return cases


def records(seed=1, n=220):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key, h = f"/data/x{r.randrange(5)}/{r.randrange(10**9):09d}.jpg", r.randbytes(64)
        if out and r.random() < 0.6:
            _, key2, h2 = r.choice(out)
            if key2 is not None and r.random() < 0.7:
                key = list(key2)
                for _ in range(r.randrange(5)):
                    key[r.randrange(len(key)) if key else 0 : 0] = r.choice("abc")
                key = "".join(key)
            if h2 is not None and len(h2) == 64:
                x = int.from_bytes(h2)
                for b in r.sample(range(512), r.choice([0, 0, 3, 58, 59, 60, 70])):
                    x ^= 1 << b
                h = x.to_bytes(64)
        if r.random() < 0.15:
            h = r.choice([None, b"", b"short", h[:63]])
        if r.random() < 0.05:
            key = r.choice([None, "", "a"])
        out.append((i * 2 + 5, key, h))
    return out


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, k, None if h is None else bytearray(h), 1, 2, "z") for i, k, h in rows], schema)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def brute_pairs(rows, same_key_too=False):
    bits = [int.from_bytes(h) if h is not None and len(h) == 64 else None for _, _, h in rows]
    out = set()
    for j, (bj, kj, _) in enumerate(rows):
        for i in range(j):
            bi, ki, _ = rows[i]
            if ki == kj:
                if same_key_too and bits[i] is not None and bits[j] is not None and (bits[i] ^ bits[j]).bit_count() < 60:
                    out.add((min(bi, bj), max(bi, bj)))
                continue
            if bits[i] is not None and bits[j] is not None:
                near = (bits[i] ^ bits[j]).bit_count() < 60
            else:
                near = ki is not None and kj is not None and abs(len(ki) - len(kj)) <= 3 and edits(ki, kj) <= 3
            if near:
                out.add((min(bi, bj), max(bi, bj)))
    return out


def test_near_pairs(spark):
    rows = records()
    got = [(r.idx_a, r.idx_b) for r in near_records.near_pairs(frame(spark, rows)).collect()]
    want = brute_pairs(rows)
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 1 and len(want) > 100


def test_copies_with_different_keys_and_equal_records(spark):
    h = bytes(64)
    rows = [(i, f"k{i % 7}", h) for i in range(30)] + [(100, None, h), (101, None, h)]
    got = {(r.idx_a, r.idx_b) for r in near_records.near_pairs(frame(spark, rows)).collect()}
    assert got == brute_pairs(rows)


def test_many_equal_records_are_no_pairs(spark):
    """A third of the rows are the same record: their pairs would be millions, and none is a result."""
    rows = records(6, 60)
    rows += [(10_000 + i, "/same/key.jpg", b"\5" * 64) for i in range(4000)] + [(20_000, "/other/key.jpg", b"\5" * 64)]
    got = near_records.near_pairs(frame(spark, rows))
    assert got.filter("idx_a >= 10000").count() == 4000
    assert {(r.idx_a, r.idx_b) for r in got.filter("idx_b < 10000").collect()} <= brute_pairs(rows[:60])


def find(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def test_groups(spark):
    rows = records(3)
    got = {r.idx: r.group_idx for r in near_records.groups(frame(spark, rows)).collect()}
    # records of equal keys are no pair of different records, yet equal bits join them
    assert got == find(brute_pairs(rows, same_key_too=True))


def test_empty_records(spark):
    empty = frame(spark, [])
    assert near_records.near_pairs(empty).count() == 0 and near_records.groups(empty).count() == 0
    only_null = frame(spark, [(None, None, None), (1, None, None)])
    assert near_records.near_pairs(only_null).count() == 0


BATCH = "batch_id int, idx long, keys string, v_dhash binary, status int, id string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decide(spark, seed):
    r = random.Random(seed)
    rows = records(seed, 260)
    old, new = rows[:100], [(r.choice([3, 1, 7, 8, 20]), *x) for x in rows[100:]]
    new += r.sample(new, 20) + [(None, 99_999, "a", None), (4, None, "b", None)]
    r.shuffle(new)
    df = spark.createDataFrame([(b, i, k, None if h is None else bytearray(h), 0, "x") for b, i, k, h in new], BATCH)
    got = history.decide(frame(spark, old), df).collect()
    assert len(got) == 160
    want = brute_force(old, new)
    assert len({x.idx for x in got if x.is_case} ^ want) <= 1 and want


@pytest.mark.parametrize("held", [0, 10**6])
def test_batches_one_at_a_time(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(history.HistoryIndex, "HELD_ROWS", held)
    rows = records(9, 240)
    old, new = rows[:120], [(1 + i // 40, *x) for i, x in enumerate(rows[120:])]
    index = history.HistoryIndex(spark, str(tmp_path / "index"), capacity=1000)
    index.add(frame(spark, old), 0)
    got = set()
    for b in (1, 2, 2, 3):  # the second is delivered again
        got |= {r.idx for r in index.take(frame(spark, [x[1:] for x in new if x[0] == b] * 2), b).collect()}
    want = brute_force(old, new)
    assert len(got ^ want) <= 1 and want
    assert spark.read.parquet(str(tmp_path / "index" / "records")).count() == 240 - len(got)


def test_first_batch_of_an_empty_index(spark, tmp_path):
    index = history.HistoryIndex(spark, str(tmp_path / "index"), capacity=1000)
    assert index.take(frame(spark, []), 0).count() == 0
    assert index.take(frame(spark, records(2, 5)[:1]), 1).count() == 0
    assert index.take(frame(spark, records(2, 5)[:1]), 2).count() == 1


def test_chain_over_batches(spark):
    """Each near the one before: every second one is a case."""
    hashes = [(((1 << (40 * i)) - 1) % (1 << 512)).to_bytes(64) for i in range(9)]
    new = [(i, 100 + i, f"k{i}", h) for i, h in enumerate(hashes)]
    df = spark.createDataFrame([(b, i, k, bytearray(h), 0, "x") for b, i, k, h in new], BATCH)
    got = {r.idx for r in history.decide(frame(spark, []), df).filter("is_case").collect()}
    assert got == brute_force([], new) == {101, 103, 105, 107}


def test_decide_on_empty_tables(spark):
    none = spark.createDataFrame([], BATCH)
    assert history.decide(frame(spark, records(5, 10)), none).count() == 0
    assert history.decide(frame(spark, []), none).count() == 0


def test_same_batch_is_not_compared(spark):
    h = bytearray(64)
    df = spark.createDataFrame([(1, 1, "a", h, 0, ""), (1, 2, "a", h, 0, ""), (2, 3, "a", None, 0, ""), (2, 4, None, h, 0, ""), (2, 5, None, None, 0, "")], BATCH)
    assert {r.idx for r in history.decide(frame(spark, []), df).filter("is_case").collect()} == {3, 4}


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    links += links[:20] + [(b, a) for a, b in links[:20]]
    df = spark.createDataFrame([(a, b, "x") for a, b in links] + [(1, None, ""), (None, 2, ""), (900, 900, "")], "a long, b long, u string")
    got = [(x.idx, x.group_idx) for x in components(df).collect()]
    assert len(got) == len(set(got)) and dict(got) == find([x for x in links if x[0] != x[1]])


def test_links_of_pairs(spark):
    rows = [(1, 2, 0), (3, 4, 59), (5, 6, 60), (7, 8, -1), (9, 9, 3), (10, None, 3), (None, 11, 3), (12, 13, None)]
    df = spark.createDataFrame([(*x, None) for x in rows], "m_i long, m_j long, m_diff int, a string")
    assert {(x.idx, x.group_idx) for x in components(links_of_pairs(df)).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert components(links_of_pairs(df.limit(0))).count() == 0


def plain_seen(stream, known):
    have, out = {k for k in known if k is not None}, set()
    for i, k in sorted((x for x in stream if x[0] is not None), key=lambda x: x[0]):
        if k is not None:
            if k in have:
                out.add(i)
            have.add(k)
    return out


def run_seen(spark, stream, known, **kw):
    s = spark.createDataFrame([(i, None if k is None else bytearray(k), "x") for i, k in stream], "id long, key binary, print string")
    got = [r.id for r in seen.seen_before(s, spark.createDataFrame([(None if k is None else bytearray(k),) for k in known], "key binary"), **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_seen_before(spark, monkeypatch):
    monkeypatch.setattr(seen, "CHUNK", 500)
    r = random.Random(6)
    keys = [r.randbytes(16) for _ in range(3000)]
    stream = [(i, r.choice(keys) if r.random() < 0.97 else None) for i in range(4000)] + [(5000 + i, keys[0]) for i in range(2000)]
    r.shuffle(stream)
    stream += [(None, keys[1]), (9999, b""), (10_000, b"")]
    known = keys[:300] + keys[:5] + [None]
    assert run_seen(spark, stream, known) == plain_seen(stream, known)


def test_seen_before_nothing(spark):
    assert run_seen(spark, [], []) == set()
    assert run_seen(spark, [], [b"a"]) == set()
    assert run_seen(spark, [(1, b"a"), (2, b"a")], []) == {2}


def test_filter_holds_and_merges():
    import numpy as np

    r = np.random.default_rng(1)
    for bits in (9, 20, 33, 50, 64):
        a, b = (np.unique(r.integers(0, 2**64 if bits == 64 else 2**bits, 1000, dtype=np.uint64)) for _ in "ab")
        f = seen.QuotientFilter(a, bits).merged(seen.QuotientFilter(b, bits), bits)
        assert f.prints().tolist() == sorted(a.tolist() + b.tolist())
        ask = r.integers(0, 2**bits - 1, 1000, dtype=np.uint64)
        have = set(a.tolist()) | set(b.tolist())
        assert f.has(ask).tolist() == [x in have for x in ask.tolist()] and f.has(a).all() and f.has(b).all()
    none = seen.QuotientFilter(np.empty(0, np.uint64), 40)
    assert not none.has(np.array([0, 5], np.uint64)).any()


def test_stored_filters_are_the_same(spark):
    import numpy as np

    r = np.random.default_rng(3)
    for bits in (9, 20, 33, 50, 64):
        for n in (0, 1, 500):
            f = seen.QuotientFilter(np.unique(r.integers(0, 2**64 if bits == 64 else 2**bits, n, dtype=np.uint64)), bits)
            g = seen.QuotientFilter.load(f.offsets.tobytes(), f.remainders.tobytes(), bits)
            assert (g.size, g.shift, g.kind) == (f.size, f.shift, f.kind) and g.prints().tolist() == f.prints().tolist()


def test_batches_meet_the_stored_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "CHUNK", 100)
    r = random.Random(9)
    keys = [r.randbytes(8) for _ in range(600)]
    index = seen.SeenFilter(spark, str(tmp_path / "seen"), 2000)
    before = []
    for b in range(4):
        batch = [(1000 * b + i, r.choice(keys) if r.random() < 0.95 else None) for i in range(300 if b != 2 else 0)]
        df = spark.createDataFrame([(i, None if k is None else bytearray(k), "x") for i, k in batch], "id long, key binary, bucket string")
        got = {x.id for x in index.take(df).collect()}
        assert got == {i for i in plain_seen(before + batch, []) if i >= 1000 * b}
        before += batch


def test_error_rates_are_those_of_the_filter(spark, monkeypatch):
    r = random.Random(7)
    keys = [bytearray(r.randbytes(16)) for _ in range(4000)]
    stream = spark.createDataFrame([(i, k) for i, k in enumerate([*keys, *keys[:200], None])], "id long, key binary")
    known = spark.createDataFrame([(bytearray(r.randbytes(16)),) for _ in range(500)] + [(keys[0],)], "key binary")
    got = {x.remainder_bits: x for x in seen.error_rates(stream, known, (2, 6, 32)).collect()}
    for b in (2, 6):
        assert got[b].new_keys == 3999 and got[b].keys == 4500 and abs(got[b].measured - got[b].derived) < 0.2 * got[b].derived
        assert got[b].bits == seen.bits_for(4702, b) and got[b].measured <= 2.0**-b
    assert (got[32].wrong, got[32].measured) == (0, 0.0) and got[32].derived == pytest.approx(2.0 ** -got[32].bits * (501 + 4499) / 2, rel=0.01)
    assert all(x.missed == 0 for x in got.values())
    assert seen.error_rates(stream.limit(0), known.limit(0), (8,)).count() == 0
    monkeypatch.setattr(seen, "seen_before", lambda stream, *a: stream.filter("id < 600").select("id"))
    assert [(x.missed, x.wrong) for x in seen.error_rates(stream, known, (8,)).collect()] == [(200, 599)]

