"""Groups of records that differ by small edits (problem 2).

A record is the set of its bit tokens, or, where its hash is missing, of its key's segments. Records with equal bits
(or equal keys) have equal answers, so one of them is compared and the answers of the others are derived from it;
only then are they written out for the records themselves. See segments.py for the index lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components
from .segments import near_bits, near_strings

BITS, BELOW, EDITS = 512, 60, 3


def _ready(records: DataFrame) -> DataFrame:
    present = F.length("v_dhash") == BITS // 8
    return records.select(F.col("idx").cast("long").alias("idx"), "keys", F.when(present, F.col("v_dhash")).alias("bits")).filter(F.col("idx").isNotNull())


def hash_classes(records: DataFrame) -> DataFrame:
    """``bits, rep, members``: each hash that occurs, its smallest idx and the number of its records."""
    return _ready(records).filter(F.col("bits").isNotNull()).groupBy("bits").agg(F.min("idx").alias("rep"), F.count("*").alias("members"))


def class_links(classes: DataFrame, below: int = BELOW) -> DataFrame:
    """``a, b, distance`` between the smallest idx of classes of different bits."""
    return near_bits(classes.select(F.col("rep").alias("id"), "bits", F.lit(3).alias("side")), BITS, below)


def _key_links(records: DataFrame, edits: int) -> DataFrame:
    """``a, b`` between the smallest idx of different keys, at least one of them of a record without bits."""
    keys = records.filter(F.col("keys").isNotNull()).groupBy("keys").agg(F.min("idx").alias("id"), F.max(F.when(F.col("bits").isNull(), 3).otherwise(1)).alias("side"))
    return near_strings(checkpointed(keys.select("id", F.col("keys").alias("s"), "side")), edits)


def near_pairs(records: DataFrame, below: int = BELOW, edits: int = EDITS) -> DataFrame:
    """``idx_a, idx_b``, idx_a < idx_b: records with different keys whose v_dhash are both present and fewer than
    ``below`` bits apart, or of which one lacks v_dhash and whose keys are at most ``edits`` edits apart.

    records: ``idx bigint`` (unique; null rows are left out), ``keys string``, ``v_dhash binary``; a v_dhash that is
    not 64 bytes long is missing. A null key differs from any other key and is near none by edits. Other columns are
    ignored; an empty table gives no pairs. Pairs of equal bits and different keys are written out as the definition
    asks; their number is the size of the result, not a by-product.
    """
    ready = _ready(records)
    classes = checkpointed(hash_classes(records))
    links = checkpointed(class_links(classes, below))
    ends = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).distinct()
    copied = ready.filter(F.col("bits").isNotNull()).select("bits", "idx").join(classes.filter(F.col("members") > 1).select("bits", "rep"), "bits").select("rep", "idx")
    alone = classes.filter(F.col("members") == 1).select("rep").join(ends, "rep", "left_semi").select("rep", F.col("rep").alias("idx"))
    members = checkpointed(copied.union(alone).join(ready.select("idx", "keys"), "idx").select("rep", "idx", "keys"))
    # equal bits and equal keys are no pair: sets of both meet first, so that the work follows the result
    sets = checkpointed(members.groupBy("rep", "keys").agg(F.min("idx").alias("kid")))
    x, y = (sets.select(*[F.col(c).alias(f"{c}_{s}") for c in ("rep", "keys", "kid")]) for s in "xy")
    across = links.join(x, F.col("a") == F.col("rep_x")).join(y, F.col("b") == F.col("rep_y")).filter(~F.col("keys_x").eqNullSafe(F.col("keys_y")))
    within = x.join(y, (F.col("rep_x") == F.col("rep_y")) & (F.col("kid_x") < F.col("kid_y")))
    met = across.select("kid_x", "kid_y").union(within.select("kid_x", "kid_y"))
    m, n = members.alias("m"), sets.alias("n")
    of = m.join(n, (F.col("m.rep") == F.col("n.rep")) & F.col("m.keys").eqNullSafe(F.col("n.keys"))).select("n.kid", "m.idx")
    x, y = (of.select(F.col("kid").alias(f"kid_{s}"), F.col("idx").alias(f"idx_{s}")) for s in "xy")
    by_hash = met.join(x, "kid_x").join(y, "kid_y").select(F.least("idx_x", "idx_y").alias("idx_a"), F.greatest("idx_x", "idx_y").alias("idx_b"))

    key_links = checkpointed(_key_links(ready, edits))
    firsts = key_links.select(F.col("a").alias("rep")).union(key_links.select(F.col("b").alias("rep"))).distinct()
    named = ready.filter(F.col("keys").isNotNull())
    wanted = named.join(firsts, named["idx"] == firsts["rep"]).select("keys", "rep")
    listed = checkpointed(named.join(wanted, "keys").select("rep", "idx", F.col("bits").isNull().alias("missing")))
    kinds = listed.select("rep", "missing").distinct()
    x, y = (kinds.select(F.col("rep").alias(r), F.col("missing").alias(f"missing_{r}")) for r in "ab")
    met = key_links.join(x, "a").join(y, "b").filter("missing_a OR missing_b")
    x, y = (listed.select(F.col("rep").alias(r), F.col("missing").alias(f"missing_{r}"), F.col("idx").alias(f"idx_{r}")) for r in "ab")
    by_key = met.join(x, ["a", "missing_a"]).join(y, ["b", "missing_b"]).select(F.least("idx_a", "idx_b").alias("idx_a"), F.greatest("idx_a", "idx_b").alias("idx_b"))
    return by_hash.union(by_key)


def groups(records: DataFrame, below: int = BELOW, edits: int = EDITS) -> DataFrame:
    """``idx, group_idx``: the records that near pairs join, directly or over others, and the smallest idx of the group.

    Equal bits join records without writing out their pairs. A record near no other has no row.
    """
    ready = _ready(records)
    classes = checkpointed(hash_classes(records))
    hashed = ready.filter(F.col("bits").isNotNull())
    same = hashed.join(classes.filter(F.col("members") > 1).select("bits", "rep"), "bits").filter("idx != rep").select(F.col("idx").alias("a"), F.col("rep").alias("b"))
    key_links = checkpointed(_key_links(ready, edits))
    named = ready.filter(F.col("keys").isNotNull())
    firsts = key_links.select(F.col("a").alias("rep")).union(key_links.select(F.col("b").alias("rep"))).distinct()
    wanted = named.join(firsts, named["idx"] == firsts["rep"]).select("keys", "rep")
    listed = checkpointed(named.join(wanted, "keys").select("rep", "idx", F.col("bits").isNull().alias("missing")))
    # a record without bits is linked to every record of a near key: over one record for each key and kind
    kinds = listed.groupBy("rep", "missing").agg(F.min("idx").alias("first"))
    x, y = (kinds.select(F.col("rep").alias(f"rep_{s}"), F.col("first").alias(f"first_{s}"), F.col("missing").alias(f"missing_{s}")) for s in "xy")
    sides = key_links.join(x, F.col("a") == F.col("rep_x")).join(y, F.col("b") == F.col("rep_y")).filter(F.col("missing_x") | F.col("missing_y"))
    firsts_linked = sides.select(F.col("first_x").alias("a"), F.col("first_y").alias("b"))
    linked_kinds = sides.select(F.col("rep_x").alias("rep"), F.col("missing_x").alias("missing"), F.col("first_x").alias("first")).union(sides.select("rep_y", "missing_y", "first_y")).distinct()
    kin = listed.join(linked_kinds, ["rep", "missing"]).filter("idx != first").select(F.col("idx").alias("a"), F.col("first").alias("b"))
    return components(class_links(classes, below).select("a", "b").union(same).union(firsts_linked).union(kin))
