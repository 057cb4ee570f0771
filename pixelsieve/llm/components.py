"""One identifier for all records that pairs link, directly or over others (problem 4).

Large-star and small-star rewrites alternate until nothing changes. Large-star links each larger neighbour of a node to
the smallest of the node and its neighbours, small-star does so with the smaller neighbours; both keep what is
connected connected, and at the end every node is linked to the smallest of its component. Each rewrite takes the
minimum of every node's neighbours with partial aggregation and sends it back by a join on (node, salt), so that the
links of a hub are spread over SALTS tasks. What is compared between rounds is a count and a sum of hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import checkpointed, forget

SALTS = 16
MAX_ROUNDS = 100


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: ``u, v`` with u > v, distinct."""
    if large:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("low"))
    whole = parts.groupBy("u").agg(F.min("low").alias("low"), F.collect_list("salt").alias("salts"))  # at most SALTS
    lows = whole.select("u", F.least("u", "low").alias("low"), F.explode("salts").alias("salt"))
    joined = salted.join(lows, ["u", "salt"])
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = joined.filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        moved = moved.union(whole.select("u", F.col("low").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _written(links: DataFrame) -> tuple[DataFrame, dict]:
    """The links as a table, and their number and a sum of hashes, both taken while they are written."""
    seen = Observation()
    table = checkpointed(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")))
    return table, seen.get


def components(links: DataFrame) -> DataFrame:
    """``idx, group_idx`` for every end of a link (columns a, b): the smallest id of its component, itself included.

    Links with a null end or between a record and itself are no links; repeated links and either orientation count
    once. No links give no rows. Other columns are ignored.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    now = ends.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = _written(now)
    for _ in range(MAX_ROUNDS):
        old, before = now, seen
        now, seen = _written(_star(_star(old, large=True), large=False))
        forget(old)
        if before == seen:
            break
    else:
        raise RuntimeError(f"the links still changed after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("idx")).distinct().withColumn("group_idx", F.col("idx"))
    return now.select(F.col("u").alias("idx"), F.col("v").alias("group_idx")).union(roots)


def links_of_pairs(pairs: DataFrame, below: int = 60) -> DataFrame:
    """Links a, b of a pair table m_i, m_j, m_diff: both ends given and different, distance given, from 0 to below - 1."""
    return pairs.filter(F.col("m_diff").between(0, below - 1)).select(F.col("m_i").alias("a"), F.col("m_j").alias("b"))
