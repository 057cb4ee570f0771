"""The operators over the driver's tables, and the same results as SQL for DuckDB.

The tables hold no images, so texts stand in for files: their bytes for content, the means of their code points over equal stretches of
the whole text for a 17 x 17 and a 16 x 16 grid, or all their bytes for the levels of a gray image (whole_hashes). Hashes, keys and pairs
of images are taken from the project's tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, hashing, quality
from ..operators import dedup, graph, parse_lines, scanner, setops
from ..schema import DHASH, PHASH, HashSpec
from ..sources.text import hash_lines, split_line
from . import commands

RULES = quality.Rules(min_bytes=1_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_set").select("idx", F.col("keys").alias("path"), F.col("v_dhash").alias("dhash"), F.col("v_phash").alias("phash"), F.col("v_md5").alias("md5"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "batch_set").select("idx", F.col("keys").alias("path"), F.col("v_dhash").alias("dhash"), F.col("v_phash").alias("phash"), "batch_id")
    return dedup.keep_first(rows, "idx", "batch_id")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("JPG", "png", "tex", "jpeg")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.encode("text", "UTF-8").alias("content"), "text")


def md5_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", hashing.md5_hex(F.col("content")).alias("md5"))


def dedup_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).select(F.col("doc_id").alias("idx"), hashing.md5_hex(F.col("content")).alias("md5"))
    return dedup.keep_first(rows, "md5").select("idx", "md5")


def dedup_md5_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(_samples(spark, sf_dir).select("idx", "path", "md5"), "md5").select("idx", "path")


def filter_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = quality.extension(F.col("keys"))
    return table(spark, sf_dir, "sample_set").select("idx", ext.alias("ext")).filter(F.col("ext").isin("jpg", "jpeg", "png"))


def filter_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).withColumn("length", F.length("content")).filter(quality.big_enough(F.col("length"), RULES)).select("doc_id", "length")


def filter_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts framed by signatures: right, wrong head, wrong tail, or bare, by doc_id."""
    files = _files(spark, sf_dir)
    ext = quality.extension(F.col("path"))
    head = F.when(ext == "png", F.lit(quality.PNG_HEAD)).otherwise(F.lit(quality.JPEG_HEAD))
    tail = F.when(ext == "png", F.lit(quality.PNG_TAIL)).otherwise(F.lit(quality.JPEG_TAIL))
    kind = F.floor(F.col("doc_id") / 4) % 4
    framed = F.concat(F.when(kind.isin(0, 2), F.unhex(head)).otherwise(F.unhex(F.lit(""))), F.col("content"), F.when(kind.isin(0, 1), F.unhex(tail)).otherwise(F.unhex(F.lit(""))))
    return files.withColumn("content", framed).filter(quality.signed(F.col("path"), F.col("content"))).select("doc_id", "path")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("l_quantity") * 40).cast("int"), (F.col("l_extendedprice") / 40).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("width"), h.alias("height"))


def filter_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).filter(quality.well_shaped(F.col("width"), F.col("height")))


def filter_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter command; sides stand in as the length of the text and that of its title, or the first alone where there is none."""
    files = _files(spark, sf_dir).withColumn("length", F.length("content"))
    width = (F.char_length("text") / 4).cast("int")
    sides = table(spark, sf_dir, "documents").select("doc_id", width.alias("width"), F.coalesce((F.char_length("title") * 10).cast("int"), width).alias("height"), F.lit(3).alias("nChannels"))
    kept = commands.filter_files(files.select(F.col("doc_id").alias("idx"), "path"), files.select("path", "length", "content"), files.select("doc_id", "path").join(sides, "doc_id"), RULES)
    return kept.select(F.col("idx").alias("doc_id"), "path")


def _levels(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grids = []
        for text in batch.column(1).to_pylist():
            points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            edge = np.arange(n + 1) * len(points) // n
            start, count = edge[:-1], np.diff(edge)
            total = np.r_[0, np.cumsum(points)]
            grids.append(np.where(count, (total[edge[1:]] - total[start]) // np.maximum(count, 1), points[start]).tolist() if len(points) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grids, pa.list_(pa.int64()))], names=["doc_id", "grid"])


def _grid(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """``doc_id, grid``: the whole text as n levels, the mean code point of each of n equal stretches; a shorter text repeats its
    code points. An empty or null text has a null grid."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(lambda x: _levels(x, n), "doc_id long, grid array<long>")


def dhash_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, 289).select("doc_id", hashing.gradient_hash(F.col("grid")).alias("dhash"))


def phash_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, 256).select("doc_id", hashing.median_hash(F.col("grid")).alias("phash"))


def whole_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both hashes of every text as images have them, by resizing and cosine transform: all bytes of the text are the
    levels of the squarest gray image that holds them, its last row filled up with 0. Empty texts have null hashes."""
    size = F.length("content")
    width = F.ceil(F.sqrt(size)).cast("int")
    files = _files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "content", size.alias("size"), width.alias("width"))
    files = files.withColumn("height", F.when(F.col("size") > 0, F.ceil(F.col("size") / F.col("width"))).otherwise(0).cast("int"))
    data = F.rpad("content", F.col("height") * F.col("width"), F.lit(b"\0"))
    hashes = hashing.image_hashes(files.select("path", "height", "width", F.lit(1).alias("nChannels"), data.alias("data")))
    return hashes.select(F.col("path").cast("long").alias("doc_id"), bits.to_hex(F.col("v_dhash")).alias("dhash"), bits.to_hex(F.col("v_phash")).alias("phash"))


def embedding_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64)
    return rows.select("vec_id", hashing.median_hash(F.col("embedding"), 64).alias("hash"))


def popcount_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = dedup.word_rows(_samples(spark, sf_dir), DHASH, "a")
    return wide.groupBy(F.col("a_pc").cast("long").alias("bits_set")).agg(F.count("*").alias("n"))


def pairs_dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_samples(spark, sf_dir), DHASH)


def pairs_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_samples(spark, sf_dir), PHASH)


def pairs_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_samples(spark, sf_dir), DHASH, 12)


def pairs_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = HashSpec("hash", 64, 20)
    rows = embedding_hash(spark, sf_dir).select(F.col("vec_id").alias("idx"), F.unhex("hash").alias("hash"))
    return dedup.near_pairs(rows, spec)


def _remain(spark: SparkSession, sf_dir: str, spec: HashSpec) -> DataFrame:
    return setops.remain(_batches(spark, sf_dir), _samples(spark, sf_dir), spec).select("idx", "path")


def remain_dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _remain(spark, sf_dir, DHASH)


def remain_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _remain(spark, sf_dir, PHASH)


def _merge(spark: SparkSession, sf_dir: str, spec: HashSpec) -> DataFrame:
    new = _batches(spark, sf_dir)
    parts = [_samples(spark, sf_dir).select("idx", "path", spec.name), *[new.filter(c).select("idx", "path", spec.name) for c in ("batch_id % 2 = 0", "batch_id % 2 = 1")]]
    return setops.merge(parts, spec).select("part", "idx", "path")


def merge_dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, DHASH)


def merge_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merge(spark, sf_dir, PHASH)


def concat_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, "merged_list").select("idx", "path"), _samples(spark, sf_dir).select("idx", "path")]
    return dedup.concat(parts)


def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to remove so that no pair of pair_t keeps both ends."""
    edges = table(spark, sf_dir, "pair_t").filter("m_diff BETWEEN 1 AND 59 AND m_i != m_j").select(F.col("m_i").alias("i"), F.col("m_j").alias("j"))
    return graph.greedy_removal(edges)


def greedy_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """greedy_pairs as it is worked off beyond the edges that fit in one task."""
    edges = table(spark, sf_dir, "pair_t").filter("m_diff BETWEEN 1 AND 59 AND m_i != m_j").select(F.col("m_i").alias("i"), F.col("m_j").alias("j"))
    return graph.greedy_removal(edges, together=0)


def _dedup(spark: SparkSession, sf_dir: str, spec: HashSpec) -> DataFrame:
    return setops.dedup_near(_samples(spark, sf_dir).select("idx", "path", spec.name), spec)[0].select("idx", "path")


def dedup_dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup(spark, sf_dir, DHASH)


def dedup_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup(spark, sf_dir, PHASH)


def hash_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes written as ``path,hex`` and read again."""
    rows = _samples(spark, sf_dir).filter(F.length("dhash") == 64)
    path, back = split_line(F.col("value"), DHASH)
    return hash_lines(rows, DHASH).select("idx", path.alias("path"), bits.to_hex(back).alias("hex"))


def load_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path,hex`` lines split at the first comma, whatever quotes they hold; lines without a valid hash have none."""
    lines = table(spark, sf_dir, "hash_lines").select("file_name", "line_no", "line").filter("line IS NOT NULL").distinct()
    path, back = split_line(F.col("line"), DHASH, strict=True)
    return lines.select("file_name", "line_no", path.alias("path"), bits.to_hex(back).alias("hex"))


def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path_i,path_j,diff`` of the distinct links of pair_t."""
    from ..sources.text import pair_lines as lines

    pairs = table(spark, sf_dir, "pair_t").filter("m_diff BETWEEN 0 AND 59 AND m_i != m_j").select(F.greatest("m_i", "m_j").alias("i"), F.least("m_i", "m_j").alias("j"), F.col("m_diff").alias("diff")).distinct()
    return lines(pairs, table(spark, sf_dir, "merged_list").select("idx", "path")).select("i", "j", "value")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of decoder checks made up from events: exit codes, signals, time-outs and texts on stderr."""
    e = table(spark, sf_dir, "events")
    texts = ["", "libpng warning: iCCP: known incorrect sRGB profile", "fmt_mismatch:PNG!=JPEG", "pil_error:broken data stream\\nsecond line", "libpng warning: iCCP: x\\n\\nlibpng error: bad", " \\n"]
    text = F.element_at(F.array(*[F.lit(t.replace("\\n", "\n")) for t in texts]), (F.col("event_id") % 6 + 1).cast("int"))
    code = F.element_at(F.array(*[F.lit(c) for c in (0, 0, 1, -11, 0, 1, 0, -6)]), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select("event_id", F.concat(F.lit("/img/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("path"), text.alias("stderr"), code.alias("code"), (F.col("event_id") % 97 == 5).alias("late"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _checks(spark, sf_dir).select("event_id", "path", scanner.reason_of(F.col("stderr"), F.col("code"), F.col("late")).alias("reason"))
    return checked.withColumn("class", scanner.class_of(F.col("reason")))


def scanner_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).filter(F.col("class").isNotNull()).select("event_id", "path", F.regexp_replace("reason", "\n", "|").alias("reason"), "class")


def scanner_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir).withColumn("class", F.when(F.col("event_id") % 10 == 3, F.col("class")))
    return scanner.cleaned(v.select(F.col("event_id").alias("idx"), "path"), v.select("path", "class")).select("idx", "path")


def scanner_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir)
    return scanner.summary(v.select("path"), v.select("path", "class")).select("class", F.col("n").cast("long").alias("n"))


def without_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, idx, path, hash_name``: each hash that a record lacks. dedup_*, remain_*, merge_*, dedup_md5_samples and
    pipeline_full leave such records out, not as duplicates but because they cannot be compared."""
    parts = []
    for source, rows in (("sample_set", _samples(spark, sf_dir)), ("batch_set", _batches(spark, sf_dir))):
        for spec in (DHASH, PHASH):
            parts.append(dedup.missing_hash(rows, spec).select(F.lit(source).alias("source"), "idx", "path", F.lit(spec.name).alias("hash_name")))
    parts.append(_samples(spark, sf_dir).filter("md5 IS NULL").select(F.lit("sample_set").alias("source"), "idx", "path", F.lit("md5").alias("hash_name")))
    return reduce(DataFrame.unionByName, parts)


def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule on the extension, equal MD5, then near phash, then near dhash, over the image records."""
    rows = _samples(spark, sf_dir).filter(quality.extension(F.col("path")).isin("jpg", "jpeg", "png", "webp"))
    rows = dedup.keep_first(rows, "md5").filter("length(dhash) = 64 AND length(phash) = 32")
    rows = setops.dedup_near(rows, PHASH)[0]
    return setops.dedup_near(rows, DHASH)[0].select("idx", "path")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines.rejected(table(spark, sf_dir, "hash_lines"))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines.loaded(table(spark, sf_dir, "hash_lines")).withColumn("v_dhash", bits.to_hex(F.col("v_dhash")))


QUERIES = [
    md5_gen, dedup_md5, dedup_md5_samples, filter_ext, filter_size, filter_magic, filter_geometry, filter_quality, dhash_gen, phash_gen,
    whole_hashes, embedding_hash, popcount_hist, pairs_dhash, pairs_phash, pairs_banded, pairs_embedding, remain_dhash, remain_phash, merge_dhash, merge_phash,
    concat_lists, greedy_pairs, greedy_rounds, dedup_dhash, dedup_phash, hash_roundtrip, load_lines, pair_lines, scanner_classify, scanner_clean, scanner_summary,
    pipeline_full, without_hash, p5_found, p5_loaded,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
