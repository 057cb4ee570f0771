"""Which records to remove so that no two that remain are duplicates."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, forget

SALTS = 16
MAX_ROUNDS = 200
#: Two numbers each, so a few megabytes in one task.
ONE_TASK_EDGES = 100_000
GREEDY_ROUNDS = 60


def labels(edges: DataFrame) -> DataFrame:
    """``v, label`` for every end of an edge ``i, j``: the smallest vertex of its component.

    In each round all vertices of one label take the label of lowest priority that any of them meets over an edge, and
    then the label which that one takes. Priorities are hashes that change with the round, so that whatever the shape
    of the graph a constant share of the labels is expected to merge in each. A hub's edges are spread over SALTS tasks by a
    salted join.
    """
    both = _both(edges).filter("v != u").distinct()
    both = checkpointed(both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))))
    salts = checkpointed(both.select("u", "salt").distinct())  # of each vertex those that occur, so that most have few copies
    now = checkpointed(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("label")))
    for k in range(MAX_ROUNDS):
        ranked = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)).alias("p"), F.col(c).alias("x"))
        spread = salts.join(now.select(F.col("v").alias("u"), ranked("label").alias("near")), "u")
        heard = both.join(spread, ["u", "salt"]).groupBy("v").agg(F.min("near").alias("near"))
        lowest = now.join(heard, "v").groupBy("label").agg(F.min(F.least(ranked("label"), "near")).alias("low"))
        hook = checkpointed(lowest.select("label", F.col("low.x").alias("root")))
        if hook.filter("label != root").isEmpty():
            least = now.groupBy("label").agg(F.min("v").alias("least"))
            return now.join(least, "label").select("v", F.col("least").alias("label"))
        twice = hook.join(hook.toDF("root", "far"), "root").select("label", F.col("far").alias("root"))
        old, now = now, checkpointed(now.join(twice, "label").select("v", F.col("root").alias("label")))
        forget(old)
        forget(hook)
    raise RuntimeError("labels still changed")


def _both(edges: DataFrame) -> DataFrame:
    """``v, u`` for each edge ``i, j`` in either direction."""
    return edges.select(F.col("i").alias("v"), F.col("j").alias("u")).union(edges.select("j", "i"))


def cover(edges: list[tuple[int, int]]) -> list[int]:
    """Vertices removed one by one, always one of most remaining edges, the largest among equals, until none is left."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    heap = [(-len(s), -v) for v, s in near.items()]
    heapq.heapify(heap)
    gone = []
    while heap:
        d, v = heapq.heappop(heap)
        v = -v
        if v not in near or len(near[v]) != -d:
            continue  # an outdated entry
        if not d:
            break
        gone.append(v)
        for u in near.pop(v):
            near[u].discard(v)
            heapq.heappush(heap, (-len(near[u]), -u))
    return gone


def _round(edges: DataFrame) -> DataFrame:
    """``v``: the vertices that come before all their neighbours, by more edges or else by a larger id.

    Removing others can only lower a neighbour, and lowers such a vertex only if it removes a neighbour, so each of them is removed
    before any of its neighbours whatever else is, and no two are neighbours: they may go at once.
    """
    both = _both(edges)
    rank = both.groupBy("v").agg(F.count("*").alias("d")).select("v", F.struct("d", "v").alias("rank"))
    most = both.join(rank.toDF("u", "other"), "u").groupBy("v").agg(F.max("other").alias("most"))
    return rank.join(most, "v").filter("rank > most").select("v")


def greedy_removal(edges: DataFrame, together: int | None = None) -> DataFrame:
    """``idx`` of the vertices to remove, given edges ``i, j``: again and again the one of most remaining edges, the largest id
    among equals.

    Up to ``together`` edges (ONE_TASK_EDGES) are worked off in one task. More go in rounds, each removing at once all vertices that
    come before their neighbours, until so few edges are left. A chain that would take more than GREEDY_ROUNDS is left
    to tasks of one component each; components are independent, since a removal only changes its neighbours.
    """
    together = ONE_TASK_EDGES if together is None else together
    edges = checkpointed(edges.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).filter("i != j").distinct())

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"idx": pd.Series(cover(list(zip(pdf["i"].tolist(), pdf["j"].tolist()))), dtype="int64")})

    gone: list[DataFrame] = []
    left = edges.count()
    while left > together and len(gone) < GREEDY_ROUNDS:
        first = checkpointed(_round(edges))
        gone.append(first.select(F.col("v").alias("idx")))
        old, edges = edges, checkpointed(edges.join(first.toDF("i"), "i", "left_anti").join(first.toDF("j"), "j", "left_anti").select("i", "j"))
        forget(old)
        left = edges.count()
    if left > together:
        of = labels(edges)
        gone.append(edges.join(of.withColumnRenamed("v", "i"), "i").groupBy("label").applyInPandas(work, "idx long"))
    elif left or not gone:
        gone.append(edges.groupBy(F.lit(0).alias("all")).applyInPandas(work, "idx long"))
    return reduce(DataFrame.union, gone)
