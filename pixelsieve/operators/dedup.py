"""Exact copies and pairs within a Hamming distance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import hamming, popcount, word_names, words
from ..schema import HashSpec
from . import matrix_join, word_join

#: A side of at most so many rows (up to 72 bytes each) is broadcast; beyond it blocks are multiplied.
BROADCAST_ROWS = 5_000
ROWS_A_BLOCK = 20_000
#: Up to this distance, cutting the bits into one band more than may differ is exact and cheap.
BANDED_BELOW = 17


def keep_first(rows: DataFrame, key: str, order: str = "idx") -> DataFrame:
    """Of rows with equal keys the one of least ``order``; rows without a key are left out.

    Partial aggregation before the shuffle keeps one row for each key and task, so a frequent key costs no more.
    """
    cols = rows.columns
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("first"))
    return first.select("first.*")


def missing_hash(rows: DataFrame, spec: HashSpec) -> DataFrame:
    """Rows whose hash is null or of the wrong width; they are kept apart from comparisons."""
    return rows.filter(F.col(spec.name).isNull() | (F.length(spec.name) != spec.nbytes))


def word_rows(rows: DataFrame, spec: HashSpec, prefix: str = "w", order: str = "idx") -> DataFrame:
    """``idx`` and the words of the valid hashes, and the number of bits set."""
    names = word_names(spec.nbits, prefix)
    valid = rows.filter(F.length(spec.name) == spec.nbytes)
    wide = valid.select(F.col(order).alias(f"{prefix}_idx"), *[w.alias(n) for w, n in zip(words(F.col(spec.name), spec.nbits), names)])
    return wide.withColumn(f"{prefix}_pc", popcount([F.col(n) for n in names]))


def _close(spec: HashSpec, below: int):
    a, b = ([F.col(n) for n in word_names(spec.nbits, p)] for p in "ab")
    distance = hamming(a, b)
    # the difference of the counts is a lower bound of the distance
    return (F.abs(F.col("a_pc") - F.col("b_pc")) < below) & (distance < below), distance


def strategy_for(n: int, below: int) -> str:
    return "broadcast" if n <= BROADCAST_ROWS else "banded" if below <= BANDED_BELOW else "matrix"


def near_pairs(rows: DataFrame, spec: HashSpec, below: int | None = None, strategy: str | None = None) -> DataFrame:
    """``i, j, diff`` for all pairs i > j of ``idx`` that differ in fewer than ``below`` bits; exact.

    ``broadcast``: one side goes to every task, behind a check of its size. ``matrix``: both sides are cut into blocks and each pair
    of blocks meets in one task as a product of matrices. ``words``: so many groups of bits that one nearly agrees, where that compares
    less. ``blocked``: the blocks without Python. ``banded``: equal bands are joined; for small distances.
    """
    below = spec.below if below is None else below
    wide = word_rows(rows, spec, "a")
    n = rows.count() if strategy in (None, "matrix", "words", "blocked") else 0
    forced, strategy = strategy, strategy or strategy_for(n, below)
    if strategy == "words" or (strategy == "matrix" and not forced):
        probes = word_join.plan(spec.nbits, below, n, n, always=bool(forced))
        if probes:
            return word_join.near_pairs(rows, spec.name, spec.nbits, below, n, probes)
        strategy = "matrix"
    if strategy == "matrix":
        return matrix_join.near_pairs(rows, spec.name, spec.nbits, below, n)
    other = wide.toDF(*[c.replace("a", "b", 1) for c in wide.columns])
    close, distance = _close(spec, below)
    later = F.col("a_idx") > F.col("b_idx")
    if strategy == "broadcast":
        joined = wide.repartition(F.col("a_idx")).join(F.broadcast(other), later & close)
    elif strategy == "banded":
        joined = _banded(wide, other, spec, below).filter(close)
    else:
        blocks = max(1, math.ceil(n / ROWS_A_BLOCK))
        at = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        left = wide.withColumn("p", at("a_idx")).withColumn("q", F.explode(F.expr("sequence(0L, p)")))
        right = other.withColumn("q", at("b_idx")).withColumn("p", F.explode(F.expr(f"sequence(q, {blocks - 1}L)")))
        joined = left.join(right, ["p", "q"]).filter(((F.col("p") > F.col("q")) | later) & close)
    return joined.select(F.greatest("a_idx", "b_idx").alias("i"), F.least("a_idx", "b_idx").alias("j"), distance.cast("int").alias("diff"))


def _banded(wide: DataFrame, other: DataFrame, spec: HashSpec, below: int) -> DataFrame:
    """Pairs that agree in at least one of ``below`` bands: fewer differing bits than bands leave one untouched.

    The bands are contiguous bits; a pair counts in the first band in which it agrees.
    """
    def bands(p: str) -> list:
        hex_text = F.concat(*[F.lpad(F.hex(F.col(n)), 16, "0") for n in word_names(spec.nbits, p)])
        digits = spec.nbits // 4
        cut = [digits * k // below for k in range(below + 1)]
        return [F.substring(hex_text, a + 1, b - a) for a, b in zip(cut, cut[1:])]

    if below > spec.nbits // 4:
        raise ValueError("too many bands")
    left = wide.withColumn("a_bands", F.array(*bands("a"))).select("*", F.posexplode("a_bands").alias("band", "value"))
    right = other.withColumn("b_bands", F.array(*bands("b"))).select("*", F.posexplode("b_bands").alias("band", "value"))
    joined = left.join(right, ["band", "value"]).filter("a_idx > b_idx")
    first = F.array_position(F.transform(F.arrays_zip("a_bands", "b_bands"), lambda x: x["a_bands"] == x["b_bands"]), True) - 1
    return joined.filter(first == F.col("band"))


def matched(src: DataFrame, gallery: DataFrame, spec: HashSpec, below: int | None = None) -> DataFrame:
    """``idx`` of the rows of src that are near some row of the gallery; a task stops at a row's first match."""
    below = spec.below if below is None else below
    n_src, n = src.count(), gallery.count()
    if n > BROADCAST_ROWS:
        probes = word_join.plan(spec.nbits, below, n_src, n)
        if probes:
            return word_join.matched(src, gallery, spec.name, spec.nbits, below, n_src, n, probes)
        return matrix_join.matched(src, gallery, spec.name, spec.nbits, below, n_src, n)
    a, b = word_rows(src, spec, "a"), word_rows(gallery, spec, "b")
    close, _ = _close(spec, below)
    return a.join(F.broadcast(b), close, "left_semi").select(F.col("a_idx").alias("idx"))


def drop_rows(rows: DataFrame, removed: DataFrame, order: str = "idx") -> DataFrame:
    """rows without those whose ``order`` is in ``removed``."""
    return rows.join(removed.select(F.col(removed.columns[0]).alias("gone")).distinct(), F.col(order) == F.col("gone"), "left_anti")


def concat(parts: list[DataFrame]) -> DataFrame:
    """The tables one after the other, with ``part`` telling which."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
