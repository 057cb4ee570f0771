"""Queries of the problems, over the whole tables that they are meant for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import history, near_records, neighbours, packing, seen, spans, tokens
from .common import checkpointed, shared_path, table
from .components import components, links_of_pairs
from .oracle import oracle_sql  # noqa: F401

HASHES = {"v_dhash": 512, "v_phash": 256}


def _hash_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "sample_set").select(F.col("idx").alias("id"), F.col(name).alias("bits"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, nbits in HASHES.items():
        probe = table(spark, sf_dir, "knn_probe").filter(F.col("hash_name") == name).select(F.col("idx").alias("id"))
        near = neighbours.nearest(_hash_rows(spark, sf_dir, name), probe, nbits)
        parts.append(near.select(F.lit(name).alias("hash_name"), F.col("id").alias("idx"), F.col("near_id").alias("near_idx")))
    return parts[0].unionByName(parts[1])


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every record whose idx is divisible by 50, against all records; most have no near partner, so
    every list is probed, and the test gives up hardly any."""
    parts = []
    for name, nbits in HASHES.items():
        rows = _hash_rows(spark, sf_dir, name)
        near = neighbours.nearest(rows, rows.filter("id % 50 = 0").select("id"), nbits, exhaustive=True, alpha=1e-6)
        parts.append(near.select(F.lit(name).alias("hash_name"), F.col("id").alias("idx"), F.col("near_id").alias("near_idx"), "distance"))
    return parts[0].unionByName(parts[1])


def p1_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of wrong neighbours that the lists of p1_found give, against a scan of everything without the hypothesis
    test: of the probes, and of every record whose idx is divisible by 50, as ordinary records. Beside it the pairs that the lists
    bring to the test, their share of all pairs, and the shares that the test abandons after the first block and altogether."""
    parts = []
    for name, nbits in HASHES.items():
        rows = _hash_rows(spark, sf_dir, name)
        probe = table(spark, sf_dir, "knn_probe").filter(F.col("hash_name") == name).select(F.col("idx").alias("id"))
        for asked, ids in (("knn_probe", probe), ("idx % 50 = 0", rows.filter("id % 50 = 0").select("id"))):
            true = neighbours.nearest(rows, ids, nbits, exhaustive=True, alpha=0.0).select("id", "near_id")
            got = neighbours.nearest(rows, ids, nbits).select("id", "near_id", F.lit(1).alias("hit"))
            wrong = true.join(got, ["id", "near_id"], "left").agg(F.count("*").alias("neighbours"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("wrong"))
            left = lambda block: F.coalesce(F.sum(F.when(F.col("block") == block, F.col("pairs"))), F.lit(0))
            work = neighbours.scan_work(rows, ids, nbits).agg(left(0).alias("compared"), left(1).alias("first"), left(nbits // 64).alias("last"))
            present = rows.filter(F.length("bits") == nbits // 8)
            sizes = present.agg(F.count("*").alias("rows")).crossJoin(present.join(ids.distinct(), "id", "left_semi").agg(F.count("*").alias("queries")))
            parts.append(wrong.crossJoin(work).crossJoin(sizes).select(F.lit(name).alias("hash_name"), F.lit(asked).alias("asked"), "*"))  # of single rows
    of = lambda a, b: a / F.greatest(b, F.lit(1))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(
        "hash_name", "asked", "neighbours", "wrong", of(F.col("wrong"), F.col("neighbours")).alias("share"), "compared",
        of(F.col("compared"), F.col("rows") * F.col("queries")).alias("compared_share"),
        of(F.col("compared") - F.col("first"), F.col("compared")).alias("abandoned_first"), of(F.col("compared") - F.col("last"), F.col("compared")).alias("abandoned"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_records.near_pairs(table(spark, sf_dir, "sample_set"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_records.groups(table(spark, sf_dir, "sample_set"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.decide(table(spark, sf_dir, "sample_set"), table(spark, sf_dir, "batch_set")).filter("is_case").select("idx")


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and cases of each batch, the batches taken one at a time by an index that grows with what they add."""
    decided = history.arrive(table(spark, sf_dir, "sample_set"), table(spark, sf_dir, "batch_set"), shared_path(spark, "history"))
    return decided.groupBy("batch_id").agg(F.count("*").alias("records"), F.sum(F.col("is_case").cast("long")).alias("cases"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(links_of_pairs(table(spark, sf_dir, "pair_t")))


def _digests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stream = table(spark, sf_dir, "sample_set").select(F.col("idx").alias("id"), F.col("v_md5").alias("key"))
    return stream, table(spark, sf_dir, "seen_md5").select(F.col("v_md5").alias("key"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.seen_before(*_digests(spark, sf_dir)).select(F.col("id").alias("idx"))


def p6_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of p6_found's filter with 4, 8 and 12 remainder bits, where wrong ones can be counted, and with its own 32."""
    return seen.error_rates(*_digests(spark, sf_dir))


def p6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of p6_error_rates: the keys, the new ones, and that none that was seen is missed."""
    return p6_error_rates(spark, sf_dir).select("remainder_bits", "keys", "new_keys", "missed")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded and decoded again."""
    ranks = tokens.load_ranks()
    return tokens.decode(tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks=ranks).select("doc_id", "ids"), ranks=ranks).select("doc_id", "text")


def _token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), into="size").select("id", "size")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_token_sizes(spark, sf_dir), table(spark, sf_dir, "pack_capacity")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity the containers used, those that best fit alone takes, the least number that the sum of sizes allows, and
    the unused share."""
    sizes, caps = checkpointed(_token_sizes(spark, sf_dir)), table(spark, sf_dir, "pack_capacity")
    used = packing.pack(sizes, caps).groupBy("cap_id", "capacity", "container").agg(F.sum("size").alias("fill"))
    per = used.groupBy("cap_id", "capacity").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"))
    both = per.join(packing.best_fit_alone(sizes, caps), ["cap_id", "capacity"])
    return both.withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p8_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity the documents packed, and what must be 0: documents left out or packed twice, sizes that differ from the
    text's, containers beyond the capacity, documents cut although they fit, containers beyond those of best fit alone."""
    sizes, caps = checkpointed(_token_sizes(spark, sf_dir)), table(spark, sf_dir, "pack_capacity")
    packed = checkpointed(packing.pack(sizes, caps))
    by_doc = packed.groupBy("cap_id", "capacity", "id").agg(F.sum("size").alias("packed"), F.count("*").alias("n"), F.countDistinct("part").alias("parts"))
    whole = sizes.filter("id IS NOT NULL")
    docs = by_doc.join(whole, "id", "right").groupBy("cap_id", "capacity").agg(
        F.count("n").alias("documents"), F.sum((F.col("packed") != F.col("size")).cast("long")).alias("wrong_size"),
        F.sum((F.col("n") != F.col("parts")).cast("long")).alias("repeated"), F.sum(((F.col("n") > 1) & (F.col("size") <= F.col("capacity"))).cast("long")).alias("cut"),
    )
    bins = packed.groupBy("cap_id", "capacity", "container").agg(F.sum("size").alias("fill")).groupBy("cap_id", "capacity").agg(F.sum((F.col("fill") > F.col("capacity")).cast("long")).alias("overfull"), F.count("*").alias("containers"))
    out = docs.join(bins, ["cap_id", "capacity"]).join(packing.best_fit_alone(sizes, caps), ["cap_id", "capacity"])
    return out.select("cap_id", "capacity", "documents", "wrong_size", "repeated", "cut", "overfull", F.greatest(F.col("containers") - F.col("best_fit"), F.lit(0)).alias("beyond_best_fit"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.coverage(table(spark, sf_dir, "documents"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest shared runs of each pair of different texts, by the smallest doc_id of either text."""
    docs = table(spark, sf_dir, "documents")
    return spans.class_spans(docs, checkpointed(spans.text_classes(docs)), every=True)


QUERIES = [
    p1_found, p1_neighbours, p1_wrong, p2_found, p2_groups, p3_found, p3_batches, p4_found, p6_found, p6_error_rates, p6_exact, p7_ids, p7_text,
    p8_packed, p8_fill, p8_valid, p9_found, p9_coverage, p9_spans,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


