"""Near-duplicate removal within a collection, and union and difference of collections by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import HashSpec
from ..session import checkpointed
from .dedup import drop_rows, keep_first, matched, near_pairs
from .graph import greedy_removal


def dedup_near(rows: DataFrame, spec: HashSpec, below: int | None = None, order: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(survivors, pairs ``i, j, diff``): equal hashes first, of each the first row stays; then, of the rest, rows are
    removed greedily by their number of near duplicates. Rows without a valid hash are left out."""
    valid = rows.filter(F.length(spec.name) == spec.nbytes)
    first = checkpointed(keep_first(valid, spec.name, order))
    pairs = checkpointed(near_pairs(first.withColumnRenamed(order, "idx") if order != "idx" else first, spec, below))
    return drop_rows(first, greedy_removal(pairs), order), pairs


def remain(src: DataFrame, gallery: DataFrame, spec: HashSpec, below: int | None = None) -> DataFrame:
    """Rows of src near no row of the gallery; src itself is not de-duplicated. Rows without a valid hash are left out."""
    valid = src.filter(F.length(spec.name) == spec.nbytes)
    return drop_rows(valid, matched(valid, gallery, spec, below))


def merge(parts: list[DataFrame], spec: HashSpec, below: int | None = None) -> DataFrame:
    """A left fold: each further collection adds its rows that are near no row taken so far. The first is kept whole.

    ``part`` tells where a row comes from. Taken rows accumulate, so the order of the collections matters.
    """
    taken = parts[0].filter(F.length(spec.name) == spec.nbytes).withColumn("part", F.lit(0))
    for k, new in enumerate(parts[1:], 1):
        taken = checkpointed(taken.unionByName(remain(new, taken, spec, below).withColumn("part", F.lit(k))))
    return taken
