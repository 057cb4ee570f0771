import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pixelsieve.functions.quality import Rules
from pixelsieve.operators import scanner
from pixelsieve.plans import commands
from pixelsieve.schema import DHASH, MD5, PHASH
from pixelsieve.sources import images, text
from pixelsieve.streaming.incremental import accept_into


def png(pixels, pad=0, icc=None):
    """An 8-bit gray PNG of rows of levels; pad bytes go into a chunk of their own."""
    h, w = len(pixels), len(pixels[0])

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
    if icc is not None:
        out += chunk(b"iCCP", b"p\0\0" + icc)
    if pad:
        out += chunk(b"teXt", b"x" * pad)
    return out + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in pixels))) + chunk(b"IEND", b"")


def picture(seed, h=140, w=160):
    import numpy as np

    r = np.random.default_rng(seed)
    x = np.cumsum(np.cumsum(r.normal(size=(h, w)), 0), 1)
    return ((x - x.min()) / np.ptp(x) * 255).astype(int).tolist()


@pytest.fixture
def folder(tmp_path):
    base = picture(1)
    noisy = [[min(255, v + (i + j) % 2) for j, v in enumerate(row)] for i, row in enumerate(base)]
    files = {
        "a.png": png(base, 300), "b.png": png(base, 300), "c.png": png(noisy, 300), "d.png": png(picture(2), 300), "e.png": png(picture(3, 60, 160), 300),
        "f.png": png(picture(4), 300)[:-1], "g.png": b"\x89PNG\r\n\x1a\n" + b"no image at all" * 100 + bytes.fromhex("49454E44AE426082"), "tiny.png": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    names = [str(tmp_path / n) for n in (*files, "missing.png")]
    (tmp_path / "list").write_text("\n".join(names))
    return tmp_path


def test_line_order_over_many_splits(spark, tmp_path):
    lines = [f"line {i}" + "\r" * (i % 3 == 0) for i in range(5000)]
    (tmp_path / "x").write_bytes("\n".join(lines).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.idx: r.value for r in text.with_line_order(spark, str(tmp_path / "x")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(lines))


def test_list_readers(spark, tmp_path):
    (tmp_path / "l").write_bytes(b"a\n\n  b \n\t\nc,d\r")
    assert [r.path for r in text.read_paths(spark, str(tmp_path / "l")).orderBy("idx").collect()] == ["a", "", "  b ", "\t", "c,d\r"]
    assert [r.path for r in text.read_scan_list(spark, str(tmp_path / "l")).orderBy("idx").collect()] == ["a", "b", "c,d"]


def test_hash_lines_round_trip(spark, tmp_path):
    h = "0f" * 16
    (tmp_path / "x.md5").write_text(f"p,{h}\nq,r,{h}\nno comma\nbad,{h[:-1]}\nup,{h.upper()}\n,{h}\n")
    good, bad = text.read_hashes(spark, str(tmp_path / "x.md5"), MD5)
    assert [(r.idx, r.path) for r in good.orderBy("idx").collect()] == [(0, "p"), (1, "q,r"), (5, "")]
    assert [(r.idx, r.reason) for r in bad.orderBy("idx").collect()] == [(2, "no comma"), (3, "not 32 hex digits"), (4, "not 32 hex digits")]
    strict, _ = text.read_hashes(spark, str(tmp_path / "x.md5"), MD5, strict=True)
    assert [r.idx for r in strict.orderBy("idx").collect()] == [0, 5]
    text.write_lines(text.hash_lines(good, MD5), str(tmp_path / "out"))
    text.publish(spark, str(tmp_path / "out"), str(tmp_path / "one"))
    assert (tmp_path / "one").read_text() == f"p,{h}\nq,r,{h}\n,{h}"


def test_empty_results_replace_old_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a")], "idx long, value string")
    text.write_lines(rows, str(tmp_path / "o"))
    text.write_lines(rows.limit(0), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 0


def test_size_is_pushed_into_the_scan(spark, folder):
    plan = images.read_files(spark, str(folder), 500).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(length,500)" in plan


def test_pipeline(spark, folder):
    rules = Rules(min_bytes=500)
    at = commands.cmd_pipeline(spark, str(folder), str(folder / "list"), rules)
    assert at == str(folder / "list.filt.md5.dedup.phash.dedup.dhash.dedup")
    name = lambda f: sorted(r.value.rpartition("/")[2] for r in spark.read.text(str(folder / f)).collect())
    assert name("list.filt") == ["a.png", "b.png", "c.png", "d.png"]
    assert name("list.filt.md5.dedup") == ["a.png", "c.png", "d.png"]
    assert name("list.filt.md5.dedup.phash.dedup") == ["a.png", "d.png"]
    assert name("list.filt.md5.dedup.phash.dedup.dhash.dedup") == ["a.png", "d.png"]


def test_commands_in_steps(spark, folder):
    (folder / "ok").write_text("\n".join(str(folder / f"{c}.png") for c in "abcd"))
    for spec in (DHASH, PHASH):
        out = commands.run(spark, f"gen_{spec.name}", str(folder), str(folder / "ok"))
        commands.run(spark, f"dedup_{spec.name}", str(folder), out)
        assert sorted(r.value[-5:] for r in spark.read.text(f"{out}.dedup").collect()) == ["a.png", "d.png"]
        pairs = [r.value for r in spark.read.text(f"{out}.pair").collect()]
        assert len(pairs) <= 1  # equal hashes never become pairs
        commands.run(spark, f"merge_{spec.name}", str(folder), out, out, str(folder / "merged"))
        assert spark.read.text(str(folder / "merged")).count() == 4
        commands.run(spark, f"remain_{spec.name}", str(folder), out, out)
        assert spark.read.text(f"{out}.rem").count() == 0
    out = commands.run(spark, "gen_md5", str(folder), str(folder / "ok"))
    commands.run(spark, "dedup_md5", str(folder), out)
    assert spark.read.text(f"{out}.dedup").count() == 3
    with pytest.raises(ValueError, match="unknown command"):
        commands.run(spark, "merge", "x")
    with pytest.raises(ValueError, match="no md5"):
        commands.run(spark, "gen_md5", str(folder), str(folder / "list"))


def test_scan(spark, folder, tmp_path):
    (folder / "warn.png").write_bytes(png(picture(5, 20, 20), icc=b"broken"))
    (folder / "wrong.jpg").write_bytes(png(picture(5, 20, 20)))
    names = ["a.png", "warn.png", "f.png", "wrong.jpg", "d.png", "a.png", "gone.png"]
    (folder / "scanlist").write_text("\n".join(f" {folder / n} " for n in names) + "\n\n")
    commands.run(spark, "scan", "", str(folder / "scanlist"), str(folder / "clean"))
    got = [r.value.rpartition("/")[2] for r in spark.read.text(str(folder / "clean")).collect()]
    assert got == ["a.png", "d.png", "a.png"]
    side = {c: sorted(r.value.split("\t")[0].rpartition("/")[2] for r in spark.read.text(str(folder / f"{c}.txt")).collect()) for c in ("bad_clevel", "warn_clevel", "fmt_mismatch")}
    assert side == {"bad_clevel": ["f.png", "gone.png"], "warn_clevel": ["warn.png"], "fmt_mismatch": ["wrong.jpg"]}


def test_halving_finds_every_culprit():
    bad, calls = {"x3", "x7"}, []

    def check(paths, seconds):
        calls.append(len(paths))
        hit = [p for p in paths if p in bad]
        return ("boom", 1, False) if hit else ("", 0, False)

    got = scanner.culprits([f"x{i}" for i in range(10)], check)
    assert {g[0] for g in got} == bad and calls[0] == 10
    assert scanner.culprits([], check) == []


def test_a_crash_or_a_hang_is_a_reason(spark):
    code = "import os, sys, time\nfor p in sys.argv[1:]:\n    os.abort() if p == 'crash' else time.sleep(9) if p == 'hang' else None"
    r = scanner.run_check(["crash"], code, 10)
    assert r[1] == -6
    assert scanner.run_check(["hang"], code, 0.5)[2]
    rows = spark.createDataFrame([("", -6, False), ("", 0, True), ("", 3, False), ("", 0, False), ("\n \n", 0, False)], "e string, c int, t boolean")
    reason = scanner.reason_of(F.col("e"), F.col("c"), F.col("t"))
    got = [(r.r, r.k) for r in rows.select(reason.alias("r"), scanner.class_of(reason).alias("k")).collect()]
    assert got == [("crash:signal SIGABRT(6)", "bad_clevel"), ("crash:timeout", "bad_clevel"), ("error:exit 3", "bad_clevel"), (None, None), (None, None)]


def test_growing_gallery(spark, tmp_path):
    h = [bytearray(b"\0" * 64), bytearray(b"\0" * 63 + b"\1"), bytearray(b"\xff" * 64)]
    batch = lambda *k: spark.createDataFrame([(i, f"p{i}", h[i]) for i in k], "idx long, path string, dhash binary")
    accept = accept_into(str(tmp_path / "g"), DHASH)
    accept(batch(0), 0)
    accept(batch(1, 2), 1)
    accept(batch(1, 2), 1)  # delivered again after a failure
    assert sorted(r.idx for r in spark.read.parquet(str(tmp_path / "g")).collect()) == [0, 2]


def test_growing_gallery_as_a_stream(spark, tmp_path):
    for i, v in enumerate((b"\0" * 64, b"\0" * 63 + b"\1")):
        spark.createDataFrame([(i, f"p{i}", bytearray(v))], "idx long, path string, dhash binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("idx long, path string, dhash binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(accept_into(str(tmp_path / "g"), DHASH)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "g")).count() == 1


def test_pipeline_keeps_undecoded_files_apart(spark, folder):
    from pixelsieve.functions import quality

    (folder / "broken.png").write_bytes(bytes.fromhex(quality.PNG_HEAD) + b"no picture " * 100 + bytes.fromhex(quality.PNG_TAIL))
    (folder / "more").write_text("\n".join(str(folder / f"{c}.png") for c in ("a", "broken", "d")))
    commands.cmd_pipeline(spark, str(folder), str(folder / "more"), Rules(min_bytes=500))
    name = lambda f: sorted(r.value.rpartition("/")[2] for r in spark.read.text(str(folder / f)).collect())
    assert name("more.filt") == ["a.png", "d.png"]
    assert name("more.filt.rejected") == ["broken.png"]
    assert name("more.filt.md5.dedup.rejected") == []


def segment(mark, body):
    return bytes([255, mark]) + (len(body) + 2).to_bytes(2) + body


def test_structure_checks(tmp_path):
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, bytes(65)) + segment(0xC0, b"\x08\0\x10\0\x10\x01\x01\x11\0")
    scan = segment(0xDA, b"\x01\x01\0\0\x3f\0")
    good = head + scan + b"ab\xff\0cd\xff\xd0ef\xff\xd1gh\xff\xd9"
    vp8 = b"VP8 " + (10).to_bytes(4, "little") + b"\0\0\0\x9d\x01\x2a\0\1\0\1"
    webp = lambda chunks: b"RIFF" + (4 + len(chunks)).to_bytes(4, "little") + b"WEBP" + chunks
    files = {
        "good.jpg": (good, ""), "tail.jpg": (good + b"tail", ""), "cut.jpg": (good[:-2], "truncated"), "gap.jpg": (head + scan + b"ab\xff\xd1gh\xff\xd9", "restart marker out of order"),
        "two.jpg": (head + scan + b"ab" + scan + b"cd\xff\xd9", ""), "none.jpg": (head + b"\xff\xd9", "truncated"), "early.jpg": (b"\xff\xd8" + scan + b"ab\xff\xd9", "scan before its frame or tables"),
        "size.jpg": (head.replace(b"\x08\0\x10\0\x10", b"\x08\0\0\0\x10") + scan + b"\xff\xd9", "no size"), "odd.jpg": (b"\xff\xd8\xffabc" + good, "truncated"),
        "good.webp": (webp(vp8), ""), "cut.webp": (webp(vp8)[:-3], "truncated"), "chunk.webp": (webp(vp8[:4] + b"\x40" + vp8[5:]), "broken chunk"), "frame.webp": (webp(vp8.replace(b"\x9d", b"\0")), "broken frame"), "empty.webp": (webp(b""), "no frame"),
    }
    for name, (data, fault) in files.items():
        (tmp_path / name).write_bytes(data)
        text, code, late = scanner.run_check([str(tmp_path / name)], scanner.CHECK, 20)
        assert not late and bool(code) == bool(fault) and fault in text, (name, text)


def test_commands_leave_no_tables(spark, folder):
    from pathlib import Path

    from pixelsieve.session import checkpointed, scope

    kept = checkpointed(spark.range(3))
    store = Path(kept._sieve_path.removeprefix("file:")).parent
    before = sorted(x.name for x in store.iterdir())
    commands.run(spark, "filter", str(folder), str(folder / "list"))
    (folder / "ok").write_text("\n".join(str(folder / f"{c}.png") for c in "abcd"))
    out = commands.run(spark, "gen_dhash", str(folder), str(folder / "ok"))
    commands.run(spark, "dedup_dhash", str(folder), out)
    assert sorted(x.name for x in store.iterdir()) == before
    with pytest.raises(ZeroDivisionError), scope():
        gone = checkpointed(spark.range(2))
        1 / 0
    assert kept.count() == 3 and sorted(x.name for x in store.iterdir()) == before and gone is not None
