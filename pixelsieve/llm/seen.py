"""Has this key been seen before? (problem 6)

A key's 64-bit hash is cut to quotient + remainder. A filter keeps only the remainders, sorted within their quotient,
and one offset for each quotient (the run metadata): REMAINDER_BITS bits a key and 32 more for about 32 keys. Keys come
in order, chunk by chunk: a chunk is looked up, its new keys become a small sorted filter, and filters of like size are
merged. The leading bits of the quotient choose the bucket, so buckets are filters of their own and work in parallel.
``SeenFilter`` keeps the filters as a table; a batch is answered from it and merged into it, and no earlier key is read again.

With as many quotients as keys, a new key meets a stored equal fingerprint with a chance of at most
keys * 2**-(quotient + remainder bits) <= 2**-REMAINDER_BITS: the rate of wrong answers. A seen key is never missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bucket, checkpointed, joined, joined_ints, pack_ints, shared_path

REMAINDER_BITS = 32
RUN = 32
CHUNK = 65_536
KEYS_A_BUCKET = 1_000_000


def _kind(bits: int) -> type:
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= bits)


class QuotientFilter:
    """Sorted fingerprints of ``bits`` bits, stored as remainders and the offset of each quotient's run."""

    def __init__(self, sorted_prints: np.ndarray, bits: int):
        self.size = len(sorted_prints)
        quotient = min(bits, max(0, math.ceil(math.log2(max(1, self.size / RUN)))))
        self.shift = bits - quotient
        self.kind = _kind(self.shift)
        self.remainders = (sorted_prints & np.uint64((1 << self.shift) - 1)).astype(self.kind)
        self.offsets = np.searchsorted(self._quotient(sorted_prints), np.arange((1 << quotient) + 1, dtype=np.uint64)).astype(np.uint32)

    @classmethod
    def load(cls, offsets: bytes, remainders: bytes, bits: int) -> QuotientFilter:
        """A filter from the bytes of its two arrays."""
        f = cls.__new__(cls)
        f.offsets = np.frombuffer(offsets, np.uint32)
        f.size = int(f.offsets[-1])
        f.shift = bits - (len(f.offsets) - 1).bit_length() + 1
        f.kind = _kind(f.shift)
        f.remainders = np.frombuffer(remainders, f.kind)
        return f

    def _quotient(self, prints: np.ndarray) -> np.ndarray:
        return prints >> np.uint64(self.shift) if self.shift < 64 else np.zeros(len(prints), np.uint64)

    def prints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.offsets) - 1, dtype=np.uint64), np.diff(self.offsets))
        return (quotients << np.uint64(self.shift) if self.shift < 64 else np.uint64(0)) | self.remainders.astype(np.uint64)

    def has(self, prints: np.ndarray) -> np.ndarray:
        """Whether each is stored: a binary search within its run."""
        q = self._quotient(prints).astype(np.int64)
        r = (prints & np.uint64((1 << self.shift) - 1)).astype(self.kind)
        lo, hi = self.offsets[q].astype(np.int64), self.offsets[q + 1].astype(np.int64)
        end = hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self.remainders[np.minimum(mid, self.size - 1)] < r) if self.size else np.zeros(len(q), bool)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(hi, mid))
        return (lo < end) & (self.remainders[np.minimum(lo, self.size - 1)] == r) if self.size else np.zeros(len(q), bool)

    def merged(self, other: QuotientFilter, bits: int) -> QuotientFilter:
        both = np.concatenate([self.prints(), other.prints()])
        both.sort(kind="stable")  # two sorted runs: a merge
        return QuotientFilter(both, bits)


def _fingerprints(batches: Iterator[pa.RecordBatch], bits: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs (fingerprint, order) by bucket; of equal ones in a batch only the first goes on, the others are seen."""
    for batch in batches:
        if not batch.num_rows:
            continue
        order = batch.column(1).to_numpy()
        prints = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        at = np.lexsort((order, prints))
        prints, order = prints[at], order[at]
        first = np.r_[True, prints[1:] != prints[:-1]]
        cells = [(-1 - int(order[0] % 64), b"", pack_ints(order[~first]))] if not first.all() else []
        prints, order = prints[first], order[first]
        lead = prints >> np.uint64(bits - 32) if bits >= 32 else prints << np.uint64(32 - bits)
        home = (lead * np.uint64(buckets)) >> np.uint64(32)
        cells += [(b, prints[p].tobytes(), pack_ints(order[p])) for b, p in by_bucket(home.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*cells), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "prints", "orders"])


_KEPT = "bucket int, ids binary, offsets binary, remainders binary"


def _answer(stored: pa.Table, cells: pa.Table, bits: int) -> pa.Table:
    """Ids of the bucket's keys that were seen before, and its filter with the new keys merged in."""
    bucket = (cells if cells.num_rows else stored)["bucket"][0].as_py()
    order = joined_ints(cells["orders"].to_pylist())
    filters = [QuotientFilter.load(r["offsets"], r["remainders"], bits) for r in stored.to_pylist()]
    out = [np.empty(0, dtype=np.int64)]
    if bucket < 0:
        out.append(order)
    else:
        prints = joined(cells["prints"].to_pylist(), np.uint64)
        at = np.argsort(order, kind="stable")
        order, prints = order[at], prints[at]
        for s in range(0, len(order), CHUNK):
            p, o = prints[s : s + CHUNK], order[s : s + CHUNK]
            seen = np.zeros(len(p), dtype=bool)
            for f in filters:
                seen |= f.has(p)
            new, first = np.unique(p, return_index=True)  # of equal ones in a chunk the first in order
            again = np.ones(len(p), dtype=bool)
            again[first] = False
            out.append(o[seen | again])
            fresh = QuotientFilter(new[~seen[first]], bits)
            while filters and filters[-1].size <= 2 * fresh.size:
                fresh = filters.pop().merged(fresh, bits)
            filters.append(fresh)
    while len(filters) > 1:
        filters[-2:] = [filters[-2].merged(filters[-1], bits)]
    kept = [(f.offsets.tobytes(), f.remainders.tobytes()) for f in filters] or [(None, None)]
    return pa.table([pa.array([x], t) for x, t in zip((bucket, pack_ints(np.concatenate(out)), *kept[0]), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "ids", "offsets", "remainders"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(joined_ints(batch.column(0).to_pylist()))], names=["id"])


def bits_for(keys: int, remainder_bits: int = REMAINDER_BITS) -> int:
    """Bits of quotient and remainder for so many keys."""
    return min(64, math.ceil(math.log2(max(2, keys))) + remainder_bits)


class SeenFilter:
    """The keys of all batches so far as sorted filters under ``path``, for at most about ``capacity`` keys.

    A filter has 4 bytes a key with 32 remainder bits, and 1 for each KEYS_A_BUCKET keys. Each batch writes its own version of the
    filters and reads that of the batch before, so a batch can be taken again after a failure.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int, remainder_bits: int = REMAINDER_BITS):
        self.spark, self.path, self.batch = spark, path, 0
        self.bits, self.buckets = bits_for(capacity, remainder_bits), max(12, math.ceil(capacity / KEYS_A_BUCKET))

    def take(self, batch: DataFrame) -> DataFrame:
        """``id`` of each record of the batch (``id, key``) whose key occurred in an earlier batch or at a smaller id of this one."""
        bits, buckets = self.bits, self.buckets
        rows = batch.filter("key IS NOT NULL AND id IS NOT NULL").select(F.xxhash64("key").alias("print"), F.col("id").cast("long").alias("order"))
        cells = rows.mapInArrow(lambda x: _fingerprints(x, bits, buckets), "bucket int, prints binary, orders binary")
        if self.batch:
            stored = self.spark.read.schema(_KEPT).parquet(f"{self.path}/{self.batch}").filter("offsets IS NOT NULL").drop("ids")
        else:
            stored = self.spark.createDataFrame([], "bucket int, offsets binary, remainders binary")
        self.batch += 1
        at = f"{self.path}/{self.batch}"
        stored.groupBy("bucket").cogroup(cells.groupBy("bucket")).applyInArrow(lambda a, b: _answer(a, b, bits), _KEPT).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(_KEPT).parquet(at).select("ids").mapInArrow(_ids, "id long")


def seen_before(stream: DataFrame, known: DataFrame, remainder_bits: int = REMAINDER_BITS) -> DataFrame:
    """``id`` of each record of the stream whose key occurs in ``known`` or at a smaller id of the stream.

    stream: ``id bigint`` (unique, not negative), ``key`` (binary or string); known: ``key``. Null keys are never seen and
    match nothing; rows with a null id are left out; repeated known keys count once. Empty tables are allowed.
    A new key is taken for seen with a chance of at most 2**-remainder_bits; see error_rates for the measured share.
    """
    spark = stream.sparkSession
    index = SeenFilter(spark, shared_path(spark, "seen"), stream.count() + known.count(), remainder_bits)
    both = known.select(F.lit(-1).cast("long").alias("id"), "key").union(stream.filter("id IS NOT NULL").select(F.col("id").cast("long"), "key"))
    return index.take(both).filter("id >= 0")


def error_rates(stream: DataFrame, known: DataFrame, remainder_bits: tuple[int, ...] = (4, 8, 12, REMAINDER_BITS)) -> DataFrame:
    """``remainder_bits, bits, keys, new_keys, missed, wrong, measured, derived``: the answers of ``seen_before`` with so many bits,
    all of them, beside those of the exact keys.

    missed is the number of keys that were seen and taken for new, always 0; wrong that of new keys (their first occurrence)
    taken for seen, and measured their share. The derived share is the mean of 1 - (1 - 2**-bits)**m over the m = 0, 1, ... distinct
    keys that came before.
    """
    rows = known.filter("key IS NOT NULL").select("key", F.lit(-1).cast("long").alias("id"))
    exact = rows.union(stream.filter("key IS NOT NULL AND id IS NOT NULL").select("key", F.col("id").cast("long")))
    firsts = checkpointed(exact.groupBy("key").agg(F.min("id").alias("id"), F.sum((F.col("id") >= 0).cast("long")).alias("n")))
    size = stream.count() + known.count()
    new = F.col("id") >= 0
    # seen records by the exact keys: all of the stream but the first of each new key
    counts = firsts.agg(F.count("*").alias("keys"), F.coalesce(F.sum(new.cast("long")), F.lit(0)).alias("new_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")).first()
    parts = []
    for r in remainder_bits:
        said = seen_before(stream, known, r)
        both = said.join(firsts.filter(new).select("id", F.lit(1).alias("first")), "id", "left")
        wrong = both.agg(F.count("*").alias("said"), F.count("first").alias("wrong"))
        lit = {k: F.lit(v).cast("long") for k, v in counts.asDict().items()}
        parts.append(wrong.select(F.lit(r).alias("remainder_bits"), F.lit(bits_for(size, r)).alias("bits"), lit["keys"].alias("keys"), lit["new_keys"].alias("new_keys"), (lit["records"] - lit["new_keys"] - F.col("said") + F.col("wrong")).alias("missed"), "wrong"))
    return _rates(reduce(DataFrame.unionByName, parts).filter("keys > 0"))


def _rates(whole: DataFrame) -> DataFrame:
    q, m0 = F.pow(F.lit(2.0), -F.col("bits")), F.col("keys") - F.col("new_keys")
    # log1p and expm1 keep the digits that 1 - q loses when q is small
    power = lambda m: F.expm1(m * F.log1p(-q))
    derived = 1 - (power(m0) - power(F.col("keys"))) / (q * F.greatest(F.col("new_keys"), F.lit(1)))
    # where even that leaves nothing of the difference to 1: m * q on average
    derived = F.when(q * F.col("keys") < 1e-6, q * (m0 + F.col("keys") - 1) / 2).otherwise(derived)
    return whole.select("remainder_bits", "bits", "keys", "new_keys", "missed", "wrong", (F.col("wrong") / F.greatest("new_keys", F.lit(1))).alias("measured"), F.when(F.col("new_keys") == 0, 0.0).otherwise(derived).alias("derived"))
