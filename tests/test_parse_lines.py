import random

import pyarrow as pa
from pyspark.sql import functions as F

from pixelsieve.operators import parse_lines as P

H = "ab" * 64
LINES = [
    None, "", "\r", ",", "a,", f"a,{H}", f"a,{H}\r", f"a,{H}\r\r", f'"a,b",{H}', f'"a""b",{H}', f'"a"b,{H}', f'a"b,{H}', f'"a,{H}', f'"a","{H}"', f",{H}", f'"",{H}',
    f"a,{H},", f'""",{H}', f'""","{H}', f'a,"{H}"x', f"é,{H}", f"a,{H.upper()}", f"a,{H[:-1]}", f"a,{H}0", f" ,{H}", f"{'x' * 100_000},{H}", f"a\nb,{H}",
]


def reason_of(line: str | None) -> str | None:
    """The same for one line, character by character."""
    text = (line or "").removesuffix("\r")
    fields, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            value, i = "", i + 1
            while True:
                if i >= len(text):
                    return "quoting"
                if text[i] != '"':
                    value, i = value + text[i], i + 1
                elif text[i + 1 : i + 2] == '"':
                    value, i = value + '"', i + 2
                else:
                    i += 1
                    break
            if i < len(text) and text[i] != ",":
                return "quoting"
        else:
            end = text.find(",", i)
            end = len(text) if end < 0 else end
            value, i = text[i:end], end
            if '"' in value:
                return "quoting"
        fields.append(value)
        if i >= len(text):
            break
        i += 1
    if len(fields) != 2:
        return "columns"
    if not fields[0] or len(fields[1]) != 128 or set(fields[1]) - set("0123456789abcdef"):
        return "value"
    return None


def test_reasons_agree_with_a_plain_parser():
    r = random.Random(1)
    lines = list(LINES)
    for _ in range(20_000):
        s = "".join(r.choice('",,a\r') for _ in range(r.randint(0, 9)))
        if r.random() < 0.4:
            s += r.choice([",", ""]) + r.choice(["", '"']) + H + r.choice(["", '"', "\r"])
        lines.append(s)
    code, _ = P.reasons(P.Index(pa.array(lines, pa.string())))
    assert [P.REASONS[c] for c in code] == [reason_of(x) for x in lines]


def test_rows_and_rejects(spark):
    rows = [("f", i, x, "extra") for i, x in enumerate(LINES)] * 2
    df = spark.createDataFrame(rows, "file_name string, line_no long, line string, reason string")
    got = {r.line_no: r for r in P.parse(df).collect()}
    assert len(got) == len(LINES) and P.parse(df).count() == 2 * len(LINES)
    for i, x in enumerate(LINES):
        assert got[i].reason == reason_of(x)
        assert (got[i].keys is None) == (got[i].v_dhash is None) == (got[i].reason is not None)
    assert got[8].keys == "a,b" and got[9].keys == 'a"b' and bytes(got[13].v_dhash).hex() == H and got[20].keys == "é" and got[26].keys == "a\nb"
    assert P.rejected(df).count() + P.loaded(df).count() == len(LINES)


def test_empty_table(spark):
    df = spark.createDataFrame([], "file_name string, line_no long, line string")
    assert P.parse(df).count() == 0


def test_null_names_and_numbers(spark):
    df = spark.createDataFrame([(None, None, f"a,{H}"), (None, None, "x")], "file_name string, line_no long, line string")
    assert sorted(str(r.reason) for r in P.parse(df).collect()) == ["None", "columns"]


def test_same_as_plain_on_the_table(spark, small):
    df = spark.read.parquet(f"{small}/hash_lines.parquet")
    want = {(r.file_name, r.line_no, reason_of(r.line)) for r in df.collect()}
    got = [(r.file_name, r.line_no, r.reason) for r in P.rejected(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in want if x[2]}
    assert df.filter(F.col("line").isNotNull()).count() > 0


def test_slices_of_a_column():
    lines = pa.array(["x", f"a,{H}", None, f'"b""c",{H}', "y,z"], pa.string())
    for part in (lines, lines[1:], lines[1:4], lines[5:], lines[:0]):
        out = next(P._parse(iter([pa.RecordBatch.from_arrays([part, pa.array(range(len(part)), pa.int64()), part], names=["f", "n", "l"])]), 2, 128))
        assert out["reason"].to_pylist() == [reason_of(x) for x in part.to_pylist()]
        assert [x for x in out["keys"].to_pylist() if x] == [k for k, x in (("a", f"a,{H}"), ('b"c', f'"b""c",{H}')) if x in part.to_pylist()]
