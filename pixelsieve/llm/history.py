"""New batches against everything accepted before (problem 3).

Keys go through the segment index of segments.py for edit distance, with the bound 0 that the problem states: their segments are stored by
length and position, a batch looks up its substrings, candidates are verified, and what is accepted is appended. Hashes differ by
substitutions, in more bits than that index can bear; they go through its tables of sampled positions. Each set of equal keys or hashes
is one entry, and pairs within the history are never formed.

What a batch accepts depends on what earlier batches accepted. All batches are settled together in rounds: a record
whose possible earlier partners are all cases is accepted, one with an accepted earlier partner is a case, the others
wait. Partners are kept as the earliest batch per key and per hash, so copies never become pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, forget
from .segments import CELLS, STRING_CELLS, emit, measure, near_bits, near_strings, plan_tables, probe_both, probe_held, string_buckets, string_cells, strings_both, strings_held

BITS, BELOW, EDITS = 512, 60, 0
MAX_ROUNDS = 10_000
WAITING, CASE, ACCEPTED = 0, 1, 2


def _bits() -> Column:
    return F.when(F.length("v_dhash") == BITS // 8, F.col("v_dhash"))


def _new(batches: DataFrame) -> DataFrame:
    """``idx, batch_id, keys, bits``: each record once, as in its first batch."""
    new = batches.filter("batch_id IS NOT NULL AND idx IS NOT NULL").select(F.col("idx").cast("long").alias("idx"), F.struct(F.col("batch_id").cast("long").alias("batch_id"), "keys", _bits().alias("bits")).alias("r"))
    return new.groupBy("idx").agg(F.min("r").alias("r")).select("idx", "r.*")


def _met_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """``keys`` of the batches that the history has, by the segment index."""
    every = old.select("keys", (F.col("idx").cast("long") * 2).alias("id"), F.lit(1).alias("side")).union(new.select("keys", F.col("idx") * 2 + 1, F.lit(2)))
    # a key of records without an idx is known by its hash
    other = F.shiftright(F.xxhash64("keys"), 3).bitwiseOR(F.lit(1 << 60)) * -2
    each = every.filter("keys IS NOT NULL").groupBy("keys", "side").agg(F.coalesce(F.min("id"), F.first(other)).alias("id"))
    rows = checkpointed(each.select("id", F.col("keys").alias("s"), "side"))
    pairs = near_strings(rows, EDITS)
    own = F.when(F.col("a").bitwiseAND(F.lit(1)) == 1, F.col("a")).otherwise(F.col("b")).alias("id")
    return rows.join(pairs.select(own).distinct(), "id", "left_semi").select(F.col("s").alias("keys"))


def decide(history: DataFrame, batches: DataFrame, below: int = BELOW) -> DataFrame:
    """``batch_id, idx, is_case`` for each record of the batches.

    history: ``idx, keys, v_dhash``; batches: ``batch_id, idx, keys, v_dhash``; other columns are ignored. A record is a
    case if its keys equal, or its v_dhash is fewer than ``below`` bits from, those of a history record or of a record of
    an earlier batch that is no case. Records of one batch are not compared. Null keys and a v_dhash that is null or not
    64 bytes long match nothing. A record delivered repeatedly counts once, as in its first batch; rows without batch_id
    or idx are left out. Empty tables give no rows (batches) or no history (history).
    """
    new = _new(batches)
    old = history.select("idx", "keys", _bits().alias("bits"))
    hashes = old.select("bits", (F.col("idx") * 2).alias("id"), F.lit(1).alias("old"), F.lit(0).alias("new"))
    hashes = hashes.union(new.select("bits", F.col("idx") * 2 + 1, F.lit(0), F.lit(1))).filter("bits IS NOT NULL AND id IS NOT NULL")
    hashes = hashes.groupBy("bits").agg(F.min("id").alias("id"), F.max("old").alias("old"), F.max("new").alias("new"))
    # the lowest bit of a class says whether the history has it, side whether a batch has it
    classes = checkpointed(hashes.select("bits", (F.col("id") * 2 + F.col("old")).alias("id"), (1 + 2 * F.col("new")).alias("side")))
    links = checkpointed(near_bits(classes, BITS, below).select("a", "b"))
    both = links.union(links.select("b", "a")).toDF("cls", "other")
    known = both.filter("other % 2 != 0").select("cls").distinct()

    named = new.join(classes.filter("side = 3").select("bits", F.col("id").alias("cls")), "bits", "left").select("batch_id", "idx", "keys", "cls")
    met_key = _met_keys(old, new).withColumn("met_key", F.lit(True))
    state = named.join(met_key, "keys", "left").join(known.withColumn("met_hash", F.lit(True)), "cls", "left")
    met = F.col("met_key").isNotNull() | F.col("met_hash").isNotNull() | F.coalesce(F.col("cls") % 2 != 0, F.lit(False))
    state = checkpointed(state.select("batch_id", "idx", "keys", "cls", F.when(met, CASE).otherwise(WAITING).alias("status")))
    near = both.filter("cls % 2 = 0 AND other % 2 = 0")
    near = checkpointed(near.union(near.select(F.col("cls"), F.col("cls"))).union(state.filter("cls IS NOT NULL AND status = 0").select("cls", F.col("cls").alias("other"))).distinct())
    for _ in range(MAX_ROUNDS):
        live = state.filter(F.col("status") != CASE)
        firsts = (F.min("batch_id").alias("live"), F.min(F.when(F.col("status") == ACCEPTED, F.col("batch_id"))).alias("accepted"))
        by_key = live.filter("keys IS NOT NULL").groupBy("keys").agg(*firsts)
        by_class = live.filter("cls IS NOT NULL").groupBy("cls").agg(*firsts)
        by_near = near.join(by_class.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.min("live").alias("live_near"), F.min("accepted").alias("accepted_near"))
        seen = state.join(by_key, "keys", "left").join(by_near, "cls", "left")
        accepted, possible = F.least("accepted", "accepted_near"), F.least("live", "live_near")
        status = F.when(F.col("status") != WAITING, F.col("status")).when(accepted < F.col("batch_id"), CASE).when(F.coalesce(possible, F.col("batch_id")) >= F.col("batch_id"), ACCEPTED).otherwise(WAITING)
        old, state = state, checkpointed(seen.select("batch_id", "idx", "keys", "cls", status.alias("status")))
        forget(old)
        if state.filter(F.col("status") == WAITING).isEmpty():
            break
    else:
        raise RuntimeError("records were still waiting")
    return state.select("batch_id", "idx", (F.col("status") == CASE).alias("is_case"))


def _keyed(rows: DataFrame, side: int) -> DataFrame:
    """``id, s, side`` of the different keys of ``idx, keys``."""
    return rows.filter("keys IS NOT NULL AND idx IS NOT NULL").groupBy("keys").agg(F.min("idx").alias("id")).select("id", F.col("keys").alias("s"), F.lit(side).alias("side"))


class HistoryIndex:
    """The accepted records as a growing index on shared storage, for batches that arrive one at a time.

    ``cells`` holds the packed segments of every accepted hash, ``strings`` those of every accepted key, ``records`` both. A batch is looked up against
    the stored segments as they are: the history is neither hashed nor grouped nor paired again, and what the batch
    accepts is appended. The look-up is a pass over the stored cells, and over the records for the candidates. If the batch is small (at most HELD_ROWS distinct
    hashes), each task holds its cells and only candidates are shuffled; for a larger batch the stored cells are shuffled by bucket.

    Each batch writes a subfolder of its own that a repeated delivery overwrites, and reads only those of smaller
    batch_id, so a batch can be taken again after a failure. capacity sets the length of segments and may not change.
    """

    HELD_ROWS = 50_000

    def __init__(self, spark: SparkSession, path: str, capacity: int = 10_000_000, below: int = BELOW):
        self.spark, self.path, self.below = spark, path, below
        self.sent: list[Broadcast] = []
        self.plan, self.buckets = plan_tables(capacity, BITS, below), string_buckets(capacity)

    def _stored(self, name: str, schema: str, batch_id: int) -> DataFrame:
        try:
            stored = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        return stored.filter(F.col("batch") < batch_id).drop("batch")

    def _append(self, name: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def _cells(self, classes: DataFrame, side: int) -> DataFrame:
        """Packed segments of ``bits, id``."""
        plan = self.plan
        rows = classes.select("id", "bits", F.lit(side).cast("long").alias("side"))
        return rows.mapInArrow(lambda x: emit(x, BITS // 8, plan), CELLS)

    def add(self, records: DataFrame, batch_id: int) -> None:
        """Appends records ``idx, keys, v_dhash`` as accepted by a batch, without looking them up."""
        rows = checkpointed(records.select(F.col("idx").cast("long").alias("idx"), "keys", _bits().alias("bits")))
        classes = rows.filter("bits IS NOT NULL AND idx IS NOT NULL").groupBy("bits").agg(F.min("idx").alias("id"))
        self._append("cells", self._cells(classes, 1), batch_id)
        self._append("strings", string_cells(_keyed(rows, 1), EDITS, self.buckets), batch_id)
        self._append("records", rows, batch_id)

    def _held(self, cells: DataFrame) -> Broadcast:
        """The cells of a batch of at most HELD_ROWS entries, 12 bytes each for every table."""
        held: dict[int, list[tuple]] = {}
        for bucket, *cell in cells.collect():
            held.setdefault(bucket, []).append(tuple(bytes(x) for x in cell))
        self.sent.append(self.spark.sparkContext.broadcast(held))
        return self.sent[-1]

    def _met_strings(self, new: DataFrame, n: int, batch_id: int) -> DataFrame:
        """``old, new`` of records with an equal token of their keys."""
        old = self._stored("strings", STRING_CELLS, batch_id)
        if n <= self.HELD_ROWS:
            known = self._held(new)
            return old.mapInArrow(lambda x: strings_held(x, known.value), "old long, new long").distinct()
        return old.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(strings_both, "old long, new long").distinct()

    def take(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """``idx`` of the batch's records that repeat something accepted by batches of smaller batch_id; adds the others.

        batch: ``idx, keys, v_dhash``; the rules are those of decide().
        """
        rows = batch.filter("idx IS NOT NULL").select(F.col("idx").cast("long").alias("idx"), F.struct("keys", _bits().alias("bits")).alias("r"))
        rows = checkpointed(rows.groupBy("idx").agg(F.min("r").alias("r")).select("idx", "r.*"))
        classes = checkpointed(rows.filter("bits IS NOT NULL").groupBy("bits").agg(F.min("idx").alias("id")))
        stored = self._stored("records", "idx long, keys string, bits binary", batch_id)
        old, new = self._stored("cells", CELLS, batch_id), self._cells(classes, 2)
        plan = self.plan
        if classes.count() <= self.HELD_ROWS:
            known = self._held(new)
            pairs = old.mapInArrow(lambda x: probe_held(x, known.value, BITS, plan), "old long, new long")
        else:
            pairs = old.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(lambda a, b: probe_both(a, b, BITS, plan), "old long, new long")
        pairs = checkpointed(pairs.distinct())
        olds = stored.select(F.col("idx").alias("old"), F.col("bits").alias("bits_a")).join(pairs.select("old").distinct(), "old", "left_semi")
        both = pairs.join(olds, "old").join(classes.select(F.col("id").alias("new"), F.col("bits").alias("bits_b")), "new").select(F.col("old").alias("a"), F.col("new").alias("b"), "bits_a", "bits_b")
        below = self.below
        near = both.mapInArrow(lambda x: measure(x, BITS // 8, below), "a long, b long, distance int").select(F.col("b").alias("id")).distinct()
        by_hash = rows.join(classes.join(near, "id", "left_semi"), "bits", "left_semi").select("idx")
        keyed = checkpointed(_keyed(rows, 2))
        met = self._met_strings(string_cells(keyed, EDITS, self.buckets), keyed.count(), batch_id)
        known = stored.select(F.col("idx").alias("old"), F.col("keys").alias("known"))
        true = known.join(met, "old").join(keyed.select(F.col("id").alias("new"), F.col("s").alias("keys")), "new").filter(F.levenshtein("known", "keys", EDITS) >= 0)
        by_key = rows.join(true.select("keys").distinct(), "keys", "left_semi").select("idx")
        cases = checkpointed(by_hash.union(by_key).distinct())
        while self.sent:  # all that needed them is written
            self.sent.pop().destroy()
        self.add(rows.join(cases, "idx", "left_anti").select("idx", "keys", F.col("bits").alias("v_dhash")), batch_id)
        return cases


def arrive(history: DataFrame, batches: DataFrame, path: str, below: int = BELOW) -> DataFrame:
    """``batch_id, idx, is_case`` as decide() gives it, by a HistoryIndex under ``path`` that takes the batches one at a time.

    The driver reads the batch_ids. Each batch costs a pass over what is stored and work by its own size.
    """
    new = checkpointed(_new(batches).withColumnRenamed("bits", "v_dhash"))
    ids = sorted(r.batch_id for r in new.select("batch_id").distinct().collect())
    if not ids:
        return history.sparkSession.createDataFrame([], "batch_id long, idx long, is_case boolean")
    n = history.count() + new.count()
    index = HistoryIndex(history.sparkSession, path, n, below)
    index.add(history, ids[0] - 1)
    out = []
    for b in ids:
        batch = new.filter(F.col("batch_id") == b)
        cases = index.take(batch, b)
        out.append(batch.join(cases.withColumn("is_case", F.lit(True)), "idx", "left").select("batch_id", "idx", F.coalesce("is_case", F.lit(False)).alias("is_case")))
    return reduce(DataFrame.unionByName, out)
