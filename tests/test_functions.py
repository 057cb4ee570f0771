import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelsieve.functions import bits, hashing, quality


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


def test_hex_round_trip_and_guards(spark):
    good = "00ff" * 16
    rows = [(good,), (good.upper(),), (good[:-1],), (good + "0",), ("g" * 64,), ("",), (None,), (good + "\n",)]
    got = spark.createDataFrame(rows, "t string").select(bits.to_hex(bits.from_hex(F.col("t"), 32)).alias("h")).collect()
    assert [r.h for r in got] == [good] + [None] * 7


def test_popcount_and_hamming(spark):
    r = random.Random(3)
    pairs = [(r.randbytes(64), r.randbytes(64)) for _ in range(50)] + [(b"\xff" * 64, b"\0" * 64), (b"\0" * 64,) * 2]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary")
    wa, wb = bits.words(F.col("a"), 512), bits.words(F.col("b"), 512)
    got = df.select(bits.popcount(wa).alias("p"), bits.hamming(wa, wb).alias("d")).collect()
    for (a, b), g in zip(pairs, got):
        x, y = int.from_bytes(a), int.from_bytes(b)
        assert (g.p, g.d) == (x.bit_count(), (x ^ y).bit_count())


def test_shift_in(spark):
    df = spark.createDataFrame([(bytearray(b"abc"), bytearray(b"z"))], "a binary, b binary")
    assert bytes(df.select(bits.shift_in(F.col("a"), F.col("b")).alias("x")).first().x) == b"bcz"


def test_extension(spark):
    paths = ["a/b.JPG", "noext", "x.tar.gz", "", "dir.d/file"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(quality.extension(F.col("p")).alias("e")).collect()
    assert [r.e for r in got] == ["jpg", "noext", "gz", "", "d/file"]


def test_size_limit(spark):
    got = spark.createDataFrame([(49_999,), (50_000,)], "n int").filter(quality.big_enough(F.col("n"))).collect()
    assert [r.n for r in got] == [50_000]


def test_shapes(spark):
    cases = {(127, 200): False, (128, 200): True, (2048, 1000): True, (2049, 1000): False, (384, 128): True, (385, 128): False, (0, 0): False, (200, 128): True}
    df = spark.createDataFrame(list(cases), "w int, h int")
    got = df.select("w", "h", quality.well_shaped(F.col("w"), F.col("h")).alias("k")).collect()
    assert {(r.w, r.h): r.k for r in got} == cases


def test_signatures(spark):
    head, tail = bytes.fromhex(quality.PNG_HEAD), bytes.fromhex(quality.PNG_TAIL)
    cases = [
        ("a.jpg", b"\xff\xd8..\xff\xd9", True), ("a.JPEG", b"\xff\xd8..\xff\xd8", False), ("a.jpg", b"\xff\xd9..\xff\xd9", False),
        ("a.png", head + b"x" + tail, True), ("a.png", head + b"x" + tail[:-1], False), ("a.webp", b"anything", True), ("a.bmp", b"", True), ("a.jpg", b"", False),
    ]
    df = spark.createDataFrame([(i, p, bytearray(c)) for i, (p, c, _) in enumerate(cases)], "i int, p string, c binary")
    got = {r.i: r.k for r in df.select("i", quality.signed(F.col("p"), F.col("c")).alias("k")).collect()}
    assert [bool(got[i]) for i in range(len(cases))] == [k for _, _, k in cases]


def _dhash_plain(grid):
    out = [grid[h][w] < grid[h][w + 1] for h in range(16) for w in range(16)] + [grid[h][w] < grid[h + 1][w] for w in range(16) for h in range(16)]
    return f"{int(''.join('01'[b] for b in out), 2):0128x}"


def test_gradient_hash_column(spark):
    ramp = [[w * 3 for w in range(17)] for _ in range(17)]
    down = [[h * 3] * 17 for h in range(17)]
    flat = [[7] * 17] * 17
    r = random.Random(1)
    noise = [[r.randrange(256) for _ in range(17)] for _ in range(17)]
    df = spark.createDataFrame([(i, [x for row in g for x in row]) for i, g in enumerate([ramp, down, flat, noise])] + [(4, [1, 2])], "i int, g array<int>")
    got = {x.i: x.h for x in df.select("i", hashing.gradient_hash(F.col("g")).alias("h")).collect()}
    assert got[0] == "f" * 64 + "0" * 64 and got[1] == "0" * 64 + "f" * 64 and got[2] == "0" * 128
    assert got[3] == _dhash_plain(noise) and got[4] is None


def test_median_hash_column(spark):
    r = random.Random(2)
    v = [r.randrange(1000) for _ in range(256)]
    s = sorted(v)
    m = (s[127] + s[128]) / 2
    want = f"{int(''.join('01'[x > m] for x in v), 2):064x}"
    df = spark.createDataFrame([(v,), ([1],)], "v array<int>")
    assert [x.h for x in df.select(hashing.median_hash(F.col("v")).alias("h")).collect()] == [want, None]


def test_pixel_hashes_agree_with_columns():
    r = np.random.default_rng(5)
    gray = r.integers(0, 256, (17, 17)).astype(np.uint8)
    assert hashing.dhash_of(gray).hex() == _dhash_plain(gray.tolist())
    assert len(hashing.phash_of(r.integers(0, 256, (100, 140)).astype(np.uint8))) == 32


def test_hashes_stand_small_changes():
    r = np.random.default_rng(6)
    base = np.cumsum(np.cumsum(r.normal(size=(200, 300)), 0), 1)
    gray = ((base - base.min()) / np.ptp(base) * 250).astype(np.uint8)
    noisy = np.clip(gray.astype(int) + r.integers(-1, 2, gray.shape), 0, 255).astype(np.uint8)
    apart = lambda f, a, b: (int.from_bytes(f(a)) ^ int.from_bytes(f(b))).bit_count()
    assert apart(hashing.dhash_of, gray, gray) == 0
    assert apart(hashing.dhash_of, gray, noisy) < 60 and apart(hashing.phash_of, gray, noisy) < 50
    assert apart(hashing.dhash_of, gray, gray[:, ::-1]) > 100


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(1, 20))
def test_area_resize_keeps_the_mean_of_flat_images(h, w, n):
    assert (hashing.area_resize(np.full((h, w), 77, np.uint8), n) == 77).all()


def test_area_resize_averages_whole_cells():
    x = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert hashing.area_resize(x, 2).tolist() == [[2, 4], [10, 12]]


def test_md5(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),)], "c binary")
    assert df.select(hashing.md5_hex(F.col("c")).alias("x")).first().x == hashlib.md5(b"abc").hexdigest()
