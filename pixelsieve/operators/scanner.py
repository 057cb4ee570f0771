"""Isolating files that a decoder rejects or warns about.

A batch of files is checked in a child process, so that a crash of a decoder costs no task; a batch that is not clean is
halved until single files remain. The text a check writes to stderr becomes a reason, and the reason a class.
"""

from __future__ import annotations

import os
import signal
import subprocess
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Starts of warnings that do no harm, and the formats that extensions promise.
HARMLESS = ("libpng warning: iCCP:", "libpng warning: iCCP ")
FORMATS = {"jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "webp": "WEBP"}
MISMATCH, WARN, BAD = "fmt_mismatch", "warn_clevel", "bad_clevel"
SINGLE_SECONDS, BATCH_SECONDS, SECONDS_A_FILE, REASON_CHARS = 15.0, 60.0, 0.05, 300
TAG = "c_warning_or_error:"


def reason_of(stderr: Column, exit_code: Column, timed_out: Column) -> Column:
    """The reason of a check's result; null if it ended well and wrote nothing."""
    text = F.regexp_replace(F.array_join(F.filter(F.split(stderr, r"\R"), lambda x: x.rlike(r"\S")), "\n"), r"^\s+|\s+$", "")
    name = F.element_at(F.create_map(*[F.lit(x) for s in signal.Signals for x in (int(s), s.name)]), -exit_code)
    return (
        F.when(timed_out, F.lit("crash:timeout"))
        .when(exit_code < 0, F.concat(F.lit("crash:signal "), F.coalesce(name, (-exit_code).cast("string")), F.lit("("), -exit_code, F.lit(")")))
        .when(text != "", F.concat(F.lit(TAG), F.substring(text, 1, REASON_CHARS)))
        .when(exit_code != 0, F.concat(F.lit("error:exit "), exit_code.cast("string")))
    )


def class_of(reason: Column) -> Column:
    """Format mismatch before harmless warning before bad; null for no reason."""
    body = F.when(reason.startswith(TAG), reason.substr(F.lit(len(TAG) + 1), F.length(reason)))
    lines = F.filter(F.split(body, r"\R"), lambda x: F.trim(x) != "")
    starts = lambda x: x.startswith(HARMLESS[0]) | x.startswith(HARMLESS[1])
    return F.when(body.startswith("fmt_mismatch:"), MISMATCH).when(F.forall(lines, starts), WARN).when(reason.isNotNull(), BAD)


def dropped(verdicts: DataFrame) -> DataFrame:
    """``path`` of every file with a class, each once."""
    return verdicts.filter(F.col("class").isNotNull()).select("path").distinct()


def cleaned(paths: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The list without dropped paths, all their occurrences, in its order (``idx``)."""
    return paths.join(dropped(verdicts), "path", "left_anti")


def summary(paths: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``class, n``: files of each class, and ``total``, ``removed`` (distinct dropped paths) and ``remaining``."""
    per = verdicts.filter(F.col("class").isNotNull()).groupBy("class").agg(F.count("*").alias("n"))
    total, gone = paths.agg(F.count("*").alias("t")), dropped(verdicts).agg(F.count("*").alias("g"))
    one = total.withColumn("k", F.lit(1)).join(gone.withColumn("k", F.lit(1)), "k")
    whole = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), n.alias("n")) for c, n in (("total", F.col("t")), ("removed", F.col("g")), ("remaining", F.col("t") - F.col("g")))])).alias("x")).select("x.*")
    return per.union(whole)


#: What a child process runs on the paths of its arguments: it ends with 1 and a line on stderr at the first fault.
CHECK = r"""
import os, struct, sys, zlib
FORMATS = {"jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "webp": "WEBP"}
def fail(text):
    print(text, file=sys.stderr); sys.exit(1)
def kind(b):
    return "PNG" if b[:8] == b"\x89PNG\r\n\x1a\n" else "JPEG" if b[:3] == b"\xff\xd8\xff" else "WEBP" if b[:4] == b"RIFF" and b[8:12] == b"WEBP" else None
def png(b):
    at, data, end, head = 8, b"", False, None
    while at + 12 <= len(b) and not end:
        n, name = struct.unpack(">I4s", b[at:at + 8]); body = b[at + 8:at + 8 + n]
        if len(body) < n or zlib.crc32(name + body) != struct.unpack(">I", b[at + 8 + n:at + 12 + n].ljust(4, b"\0"))[0]:
            return "broken chunk " + name.decode("latin-1")
        head = body if name == b"IHDR" else head
        data += body if name == b"IDAT" else b""
        if name == b"iCCP":
            try: zlib.decompress(body[body.index(b"\0") + 2:])
            except Exception: print("libpng warning: iCCP: profile is broken", file=sys.stderr)
        end = name == b"IEND"; at += 12 + n
    if not end or head is None: return "truncated"
    w, h, depth, color = struct.unpack(">IIBB", head[:10])
    want = h * (1 + (w * depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color] + 7) // 8)
    try: got = len(zlib.decompress(data))
    except Exception as e: return "broken data: %s" % e
    return None if head[12] or got == want else "wrong amount of data"
def jpeg(b):
    at, seen = 2, set()
    while at + 4 <= len(b):
        if b[at] != 255: return "no marker where one must be"
        if b[at + 1] == 255: at += 1; continue
        mark, n = b[at + 1], struct.unpack(">H", b[at + 2:at + 4])[0]
        if mark == 0xd9: break
        body = b[at + 4:at + 2 + n]
        if n < 2 or len(body) < n - 2: return "truncated"
        if 0xc0 <= mark <= 0xcf and mark not in (0xc4, 0xc8, 0xcc):
            if len(body) < 6 or 0 in struct.unpack(">HH", body[1:5]): return "no size"
            mark = 0xc0
        seen.add(mark); at += 2 + n
        if mark == 0xda:
            if not {0xc0, 0xdb} <= seen: return "scan before its frame or tables"
            restart = 0
            while True:
                at = b.find(b"\xff", at)
                if at < 0 or at + 1 >= len(b): return "truncated"
                if b[at + 1] == 0: at += 2
                elif 0xd0 <= b[at + 1] <= 0xd7:
                    if b[at + 1] != 0xd0 + restart: return "restart marker out of order"
                    restart = (restart + 1) % 8; at += 2
                else: break
    return None if 0xda in seen and b[at:at + 2] == b"\xff\xd9" else "truncated"
def webp(b):
    end, at, kinds = 8 + struct.unpack("<I", b[4:8])[0], 12, []
    if len(b) < end: return "truncated"
    while at + 8 <= end:
        name, n = struct.unpack("<4sI", b[at:at + 8])
        if at + 8 + n > end: return "broken chunk " + name.decode("latin-1")
        body = b[at + 8:at + 8 + n]
        if name == b"VP8 " and body[3:6] != b"\x9d\x01\x2a" or name == b"VP8L" and body[:1] != b"\x2f": return "broken frame"
        kinds.append(name); at += 8 + n + n % 2
    return None if {b"VP8 ", b"VP8L", b"ANMF"} & set(kinds) else "no frame"
for path in sys.argv[1:]:
    try: b = open(path, "rb").read()
    except Exception as e: fail("read_error:%s" % e)
    k = kind(b)
    if k is None: fail("decode_error:unknown format")
    wrong = {"PNG": png, "JPEG": jpeg, "WEBP": webp}[k](b)
    if wrong: fail("decode_error:" + wrong)
    want = FORMATS.get(os.path.splitext(path)[1].lower().lstrip("."))
    if want and want != k: fail("fmt_mismatch:%s!=%s" % (k, want))
"""


def run_check(paths: list[str], code: str, seconds: float) -> tuple[str, int, bool]:
    try:
        r = subprocess.run([sys.executable, "-I", "-c", code, *paths], capture_output=True, timeout=seconds)
        return r.stderr.decode(errors="replace"), r.returncode, False
    except subprocess.TimeoutExpired:
        return "", 0, True


def culprits(paths: list[str], check: Callable[[list[str], float], tuple[str, int, bool]], again: int = 2, single: int = 3) -> list[tuple[str, str, int, bool]]:
    """(path, stderr, exit code, timed out) of the files that are not clean, found by halving.

    A batch is cleared at once if it is clean at first sight; a half only after ``again`` clean runs, a single file after
    ``single`` (one for PNG), because some warnings come and go.
    """
    def clean(r: tuple[str, int, bool]) -> bool:
        return not r[2] and r[1] == 0 and not r[0].strip()

    def seconds(n: int) -> float:
        return SINGLE_SECONDS if n == 1 else max(BATCH_SECONDS, SECONDS_A_FILE * n)

    def split(part: list[str], runs: int) -> Iterator[tuple[str, str, int, bool]]:
        if len(part) == 1:
            runs = 1 if os.path.splitext(part[0])[1].lower() == ".png" else single
        for _ in range(runs):
            r = check(part, seconds(len(part)))
            if not clean(r):
                break
        else:
            return
        if len(part) == 1:
            yield (part[0], *r)
        else:
            half = len(part) // 2
            yield from split(part[:half], again)
            yield from split(part[half:], again)

    return list(split(paths, 1)) if paths else []


def scan(paths: DataFrame, batch: int = 2000, code: str = CHECK) -> DataFrame:
    """``path, reason, class`` of the files that are not clean. Paths must be readable where tasks run."""
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            names = pdf["path"].dropna().tolist()
            for s in range(0, len(names), batch):
                found = culprits(names[s : s + batch], lambda p, sec: run_check(p, code, sec))
                yield pd.DataFrame(found, columns=["path", "stderr", "code", "late"]).astype({"code": "int32", "late": "bool", "path": "str", "stderr": "str"})

    raw = paths.select("path").distinct().mapInPandas(work, "path string, stderr string, code int, late boolean")
    reasons = raw.select("path", reason_of(F.col("stderr"), F.col("code"), F.col("late")).alias("reason"))
    return reasons.withColumn("class", class_of(F.col("reason")))


def write_side_files(verdicts: DataFrame, folder: str) -> None:
    """``path<TAB>reason`` for each class, in folders named after it."""
    lines = verdicts.filter(F.col("class").isNotNull())
    for name in (BAD, WARN, MISMATCH):
        lines.filter(F.col("class") == name).select(F.concat_ws("\t", "path", "reason").alias("value")).write.mode("overwrite").text(f"{folder}/{name}.txt")
