"""Separating lines that cannot be loaded, with the reason, from valid rows (problem 5).

Structural indexing over a whole Arrow batch: the lines' bytes lie end to end; a mask of the quotes and the parity of
its prefix sums, taken within each line, tell which commas end a field; record ends are known from the lengths. Counts
per line and vector checks of the fields then give each line its reason, and gathers cut out the text and bytes of
valid rows; nothing loops over lines. Lines come cut at their ends, so a quoted line break cannot occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, COMMA, RETURN = 34, 44, 13
#: Reasons, in the order in which they are looked for.
QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"
REASONS = np.array([None, QUOTING, COLUMNS, VALUE], dtype=object)
HEX = np.zeros(256, dtype=bool)
HEX[[*b"0123456789abcdef"]] = True
NIBBLE = np.zeros(256, dtype=np.uint8)
NIBBLE[[*b"0123456789abcdef"]] = np.arange(16)


def _per_segment(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the mask lie in each [start, end)."""
    total = np.r_[0, np.cumsum(mask)]
    return total[np.maximum(end, start)] - total[start]


class Index:
    """Fields of a batch of lines: ``start``, ``end`` (of their bytes, quotes included) and ``line``."""

    def __init__(self, lines: pa.Array):
        lines = lines.fill_null("")
        _, offsets, data = lines.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64) if len(lines) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] else np.empty(0, np.uint8)
        length = np.diff(offsets)
        self.begin = offsets[:-1] - offsets[0]
        stop = self.begin + length
        has = length > 0
        cut = np.zeros(len(lines), dtype=np.int64)
        cut[has] = self.data[stop[has] - 1] == RETURN
        self.stop = stop - cut
        quote = self.data == QUOTE
        total = np.r_[0, np.cumsum(quote)]
        of = np.repeat(np.arange(len(lines)), length)
        inside = (total[:-1] - total[self.begin][of]) & 1  # quotes before it in its line
        ends = (self.data == COMMA) & (inside == 0) & (np.arange(len(self.data)) < self.stop[of])
        comma = np.flatnonzero(ends)
        # a field starts at each line's start and after each such comma
        self.start = np.concatenate([self.begin, comma + 1])
        self.line = np.concatenate([np.arange(len(lines)), of[comma]])
        order = np.lexsort((self.start, self.line))
        self.start, self.line = self.start[order], self.line[order]
        last = np.r_[self.line[1:] != self.line[:-1], True] if len(self.line) else np.empty(0, bool)
        self.end = np.where(last, self.stop[self.line], np.r_[self.start[1:] - 1, 0] if len(self.start) else self.start)
        self.fields = np.bincount(self.line, minlength=len(lines))
        self.quoted = np.zeros(len(self.start), dtype=bool)
        some = self.end > self.start
        self.quoted[some] = self.data[self.start[some]] == QUOTE
        self.broken = self._broken(quote, of, len(lines))

    def _broken(self, quote: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Lines that break the rules of quoting."""
        in_field = _per_segment(quote, self.start, self.end)
        wrong = ~self.quoted & (in_field > 0)
        closed = np.zeros(len(self.start), dtype=bool)
        long = self.quoted & (self.end - self.start >= 2)
        closed[long] = self.data[self.end[long] - 1] == QUOTE
        wrong |= self.quoted & ~closed
        # inside, quotes come in runs of even length
        inner = np.zeros(len(self.data) + 1, dtype=bool)
        f = np.flatnonzero(self.quoted & closed)
        mark = np.zeros(len(self.data) + 2, dtype=np.int64)
        np.add.at(mark, self.start[f] + 1, 1)
        np.add.at(mark, self.end[f] - 1, -1)
        inner[:-1] = (np.cumsum(mark)[: len(self.data)] > 0) & quote
        edge = np.flatnonzero(inner != np.r_[False, inner[:-1]])
        run, run_end = edge[::2], edge[1::2]
        bad = np.zeros(n, dtype=bool)
        bad[self.line[wrong]] = True
        odd = run[(run_end - run) % 2 == 1] if len(run) else run
        bad[of[odd]] = True
        return bad

    def plain(self, field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the fields without their enclosing quotes."""
        q = self.quoted[field].astype(np.int64)
        return self.start[field] + q, self.end[field] - q


def reasons(index: Index, columns: int = 2, hex_digits: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(reason code of each line, its first field): 0 valid, else the place in REASONS."""
    n = len(index.fields)
    first = np.searchsorted(index.line, np.arange(n))
    code = np.where(index.broken, 1, np.where(index.fields != columns, 2, 0))
    at = np.flatnonzero(code == 0)
    s, e = index.plain(first[at])
    s2, e2 = index.plain(first[at] + columns - 1)
    ok = (e > s) & (e2 - s2 == hex_digits)
    ok &= _per_segment(HEX[index.data], s2, e2) == e2 - s2 if len(index.data) else False
    code[at[~ok]] = 3
    return code, first


def _binary(kind: pa.DataType, data: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(length)].astype(np.int32)
    return pa.Array.from_buffers(kind, len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _texts(index: Index, field: np.ndarray) -> pa.Array:
    """The text of well-formed fields, quotes taken off and doubled ones made one."""
    s, e = index.plain(field)
    length = e - s
    at = np.repeat(s - (np.cumsum(length) - length), length) + np.arange(length.sum())
    text = _binary(pa.string(), index.data[at], length)
    doubled = index.quoted[field] & (_per_segment(index.data == QUOTE, s, e) > 0)
    return pc.if_else(pa.array(doubled), pc.replace_substring(text, '""', '"'), text) if doubled.any() else text


def _bytes(index: Index, field: np.ndarray, hex_digits: int) -> pa.Array:
    """The bytes that fields of so many hexadecimal digits stand for."""
    s, _ = index.plain(field)
    digits = NIBBLE[index.data[s[:, None] + np.arange(hex_digits)]] if len(s) else np.empty((0, hex_digits), np.uint8)
    return _binary(pa.binary(), digits[:, ::2] << 4 | digits[:, 1::2], np.full(len(s), hex_digits // 2))


def _parse(batches: Iterator[pa.RecordBatch], columns: int, hex_digits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index = Index(batch.column(2))
        code, first = reasons(index, columns, hex_digits)
        valid = code == 0
        field = first[valid]
        at = pa.array(np.cumsum(valid) - 1, mask=~valid)  # of each valid line its place among them, else null
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _texts(index, field).take(at), _bytes(index, field + columns - 1, hex_digits).take(at), pa.array(REASONS, pa.string()).take(pa.array(code))], names=["file_name", "line_no", "keys", "v_dhash", "reason"])


def parse(lines: DataFrame, hex_digits: int = 128) -> DataFrame:
    """``file_name, line_no, keys, v_dhash, reason``, one row for each row of ``lines``, in one pass without a shuffle.

    lines: ``file_name string``, ``line_no bigint``, ``line string``; other columns are ignored. A line is ``keys,hex``; one
    trailing carriage return is dropped. A valid line has ``keys`` and ``v_dhash`` and a null reason; a line that can't be
    loaded has only its reason: 'quoting', 'columns' or 'value', the first that holds. A null line counts as blank, so
    its reason is 'columns'. An empty table gives no rows. A line delivered repeatedly has a row each time.
    """
    rows = lines.select("file_name", F.col("line_no").cast("long").alias("line_no"), "line")
    return rows.mapInArrow(lambda x: _parse(x, 2, hex_digits), "file_name string, line_no long, keys string, v_dhash binary, reason string")


def rejected(lines: DataFrame) -> DataFrame:
    """``file_name, line_no, reason`` of the lines that can't be loaded, each once; only these are shuffled."""
    return parse(lines).filter("reason IS NOT NULL").select("file_name", "line_no", "reason").distinct()


def loaded(lines: DataFrame) -> DataFrame:
    """``file_name, line_no, keys, v_dhash`` of the valid lines, each different one once."""
    return parse(lines).filter("reason IS NULL").drop("reason").distinct()
