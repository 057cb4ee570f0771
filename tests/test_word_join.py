import numpy as np
import pyarrow as pa
import pytest

from pixelsieve.operators import dedup, graph, setops, word_join
from pixelsieve.plans import queries
from pixelsieve.schema import DHASH, PHASH, HashSpec


def hashes(n, width, below, seed=0):
    """Half of the rows are copies with some bits changed, fewer or more than the distance; some share whole words."""
    r = np.random.default_rng(seed)
    x = r.integers(0, 256, (n, width), dtype=np.uint8)
    for k in range(n // 2, n):
        x[k] = x[r.integers(0, k)]
        for b in r.choice(width * 8, r.integers(0, min(width * 8, int(below * 1.3) + 2)), replace=False):
            x[k, b // 8] ^= 1 << (b % 8)
    x[:30, :8] = 0
    return x


def brute(x, below):
    u = x.view(np.uint64)
    near = lambda i: np.bitwise_count(u[:i] ^ u[i]).sum(axis=1, dtype=int)
    return {(i, int(j), int(d[j])) for i in range(len(u)) for d in [near(i)] for j in np.flatnonzero(d < below)}


def frame(spark, x, name="h", start=0):
    return spark.createDataFrame([(start + i, f"p{start + i}", bytearray(v.tobytes())) for i, v in enumerate(x)], f"idx long, path string, {name} binary")


def cells(x, part):
    one = {"p": pa.array([0], pa.int32()), "q": pa.array([part], pa.int32()), "side": pa.array([0], pa.int32())}
    return pa.table(one | {"ids": [np.arange(len(x)).tobytes()], "bits": [x.tobytes()]})


@pytest.mark.parametrize("width, below", [(32, 50), (64, 60), (8, 20), (8, 8), (64, 6), (32, 100)])
@pytest.mark.parametrize("groups", [4, 5, 16])
def test_every_pair_once_over_all_groups(width, below, groups, monkeypatch):
    monkeypatch.setattr(word_join, "PAIRS", 1000)
    monkeypatch.setattr(word_join, "GATHERED", 300)
    monkeypatch.setattr(word_join, "MET", 50)
    x = hashes(400, width, below)
    probes = word_join.probes(width * 8, below, groups)
    of_part = word_join._spread(probes, 2, len(x), len(x))
    got = [tuple(r.values()) for k in range(2) for r in word_join._pairs(cells(x, k), width, below, probes, of_part).to_pylist()]
    assert len(got) == len(set(got)) and set(got) == brute(x, below)


@pytest.mark.parametrize("nbits, below", [(512, 60), (256, 50), (64, 20), (256, 3)])
@pytest.mark.parametrize("groups", range(4, 17))
def test_groups_leave_no_distance_out(nbits, below, groups):
    probes = word_join.probes(nbits, below, groups)
    of_word = {q: sum(p.flips + 1 for p in probes if p.word == q) for q in range(nbits // 64)}
    assert sum(of_word.values()) == below and all(p.most + 1 == of_word[p.word] for p in probes)
    bits = [(p.word, p.shift + k) for p in probes for k in range(p.width)]
    assert len(bits) == len(set(bits))


@pytest.mark.parametrize("spec", [HashSpec("h", 512, 60), HashSpec("h", 256, 50)])
def test_pairs_by_words_over_blocks(spark, spec, monkeypatch):
    monkeypatch.setattr(word_join, "ROWS_A_BLOCK", 100)
    x = hashes(250, spec.nbytes, spec.below, 1)
    got = [tuple(r) for r in dedup.near_pairs(frame(spark, x), spec, strategy="words").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(x, spec.below)


@pytest.mark.parametrize("spec", [DHASH, PHASH])
def test_large_tables_compare_few_pairs(spec):
    for n, most in ((60_000, 0.5), (600_000, 0.2), (2_400_000, 0.2)):
        probes = word_join.plan(spec.nbits, spec.below, n, n)
        assert 0 < sum(p.ball / 2**p.width for p in probes) < most
    assert not word_join.plan(spec.nbits, spec.nbits // 2, 600_000, 600_000)  # groups as wide as that meet nearly everything


def test_dedup_dhash_by_words(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 10)
    used = []
    real = word_join.near_pairs
    monkeypatch.setattr(word_join, "near_pairs", lambda *a: used.append(1) or real(*a))
    x = hashes(6_000, DHASH.nbytes, DHASH.below, 2)
    x[5_990:] = x[:10]
    left = {r.idx for r in setops.dedup_near(frame(spark, x, "dhash"), DHASH)[0].collect()}
    first = {}
    for i, v in enumerate(x):
        first.setdefault(v.tobytes(), i)
    kept = set(first.values())
    gone = graph.cover([(i, j) for i, j, _ in brute(x, DHASH.below) if i in kept and j in kept])
    assert used and left == kept - set(gone)


def always(monkeypatch):
    """Every comparison but the smallest goes by words."""
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", 10)
    real = word_join.plan
    monkeypatch.setattr(word_join, "plan", lambda *a, **_: real(*a, always=True))


def test_pipeline_full_by_words(spark, small, monkeypatch):
    rows = lambda: {tuple(r) for r in queries.pipeline_full(spark, small).collect()}
    want = rows()
    always(monkeypatch)
    assert want and rows() == want


@pytest.mark.parametrize("query", ["pairs_dhash", "pairs_phash", "dedup_phash"])
def test_pairs_query_by_words(spark, small, monkeypatch, query):
    rows = lambda: sorted(tuple(r) for r in queries.queries()[query](spark, small).collect())
    want = rows()
    always(monkeypatch)
    assert want and rows() == want


@pytest.mark.parametrize("query", ["remain_dhash", "merge_dhash"])
def test_galleries_by_words(spark, small, monkeypatch, query):
    rows = lambda: sorted(tuple(r) for r in queries.queries()[query](spark, small).collect())
    want = rows()
    always(monkeypatch)
    monkeypatch.setattr(word_join, "ROWS_A_BLOCK", 400)
    assert want and rows() == want
