"""Fixed-width bit strings as columns: hex text for exchange, binary for storage, 64-bit words for arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_hex(text: Column, nbytes: int) -> Column:
    """Binary of exactly 2 * nbytes lower-case hex digits; null for anything else."""
    return F.when(text.rlike(f"^[0-9a-f]{{{2 * nbytes}}}$") & ~text.contains("\n"), F.unhex(text))


def to_hex(bits: Column) -> Column:
    return F.lower(F.hex(bits))


def valid(bits: Column, nbytes: int) -> Column:
    """The bits where they have the right width, else null."""
    return F.when(F.length(bits) == nbytes, bits)


def words(bits: Column, nbits: int) -> list[Column]:
    """The bits as signed 64-bit words, most significant first."""
    text = F.hex(bits)
    return [F.conv(F.substring(text, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(nbits // 64)]


def word_names(nbits: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{k}" for k in range(nbits // 64)]


def popcount(cols: list[Column]) -> Column:
    return reduce(add, [F.bit_count(c) for c in cols])


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Number of differing bits; stays within generated code, a word at a time."""
    return reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def shift_in(bits: Column, byte: Column) -> Column:
    """Drops the first byte and appends one."""
    return F.concat(F.substring(bits, 2, 1 << 30), byte)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; the body of a lambda would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack_bits(bits: Column, nbits: int) -> Column:
    """Hex text of an array of 0 and 1, most significant first."""
    def nibble(b: Column, q: Column) -> Column:
        at = lambda k: F.get(b, (q * 4 + k).cast("int"))
        return F.substring(F.lit("0123456789abcdef"), (at(0) * 8 + at(1) * 4 + at(2) * 2 + at(3) + 1).cast("int"), F.lit(1))

    return let(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(nbits // 4 - 1)), lambda q: nibble(b, q)), ""))
