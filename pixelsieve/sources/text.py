"""Line files: path lists and ``path,hex`` files, read with their line order and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import from_hex, to_hex
from ..schema import HashSpec


def with_line_order(spark: SparkSession, path: str) -> DataFrame:
    """``idx, value``: lines as they stand (a carriage return stays), numbered from 0 in file order.

    Several files follow each other by name. Lines are numbered without gathering them: each block of a file has its
    lines counted, and a line's number is its place in its block plus the lines of the blocks before.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # one row for each block
    offsets = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("offset"))
    return lines.join(offsets, ["file", "block"]).select((F.col("at") - F.col("first") + F.col("offset")).alias("idx"), "value")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """``idx, path``: every line is a path, blank ones too."""
    return with_line_order(spark, path).withColumnRenamed("value", "path")


def read_scan_list(spark: SparkSession, path: str) -> DataFrame:
    """``idx, path``: lines stripped of white space at both ends, blank ones skipped."""
    lines = with_line_order(spark, path)
    return lines.select("idx", F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("path")).filter("path != ''")


def split_line(line: Column, spec: HashSpec, strict: bool = False) -> tuple[Column, Column]:
    """(path, binary or null) of ``path,hex``: cut at the last comma, or with strict at the first."""
    line = F.regexp_replace(line, "\r$", "") if not strict else line
    cut = F.instr(line, ",") if strict else F.length(line) - F.instr(F.reverse(line), ",") + 1
    has = F.instr(line, ",") > 0
    path = F.when(has, line.substr(F.lit(1), cut - 1)).otherwise(line)
    return path, F.when(has, from_hex(line.substr(cut + 1, F.length(line)), spec.nbytes))


def read_hashes(spark: SparkSession, path: str, spec: HashSpec, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``idx, path, <hash>`` of the valid lines, ``idx, value, reason`` of the others)."""
    lines = with_line_order(spark, path)
    p, h = split_line(F.col("value"), spec, strict)
    rows = lines.select("idx", "value", p.alias("path"), h.alias(spec.name))
    bad = rows.filter(F.col(spec.name).isNull())
    reason = F.when(F.instr("value", ",") == 0, "no comma").otherwise(f"not {2 * spec.nbytes} hex digits")
    return rows.filter(F.col(spec.name).isNotNull()).select("idx", "path", spec.name), bad.select("idx", "value", reason.alias("reason"))


def hash_lines(rows: DataFrame, spec: HashSpec) -> DataFrame:
    """``idx, value`` with ``path,hex``."""
    return rows.select("idx", F.concat_ws(",", "path", to_hex(F.col(spec.name))).alias("value"))


def pair_lines(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``value`` with ``path_i,path_j,diff`` of pairs ``i, j, diff``, i > j."""
    a, b = (rows.select(F.col("idx").alias(x), F.col("path").alias(f"path_{x}")) for x in "ij")
    return pairs.join(a, "i").join(b, "j").select("i", "j", F.concat_ws(",", "path_i", "path_j", "diff").alias("value"))


def write_lines(rows: DataFrame, path: str, order: tuple[str, ...] = ("idx",)) -> None:
    """A folder of text whose parts, in their order, hold the lines in order; an old result is always replaced."""
    rows.orderBy(*order).select("value").write.mode("overwrite").text(path)


def publish(spark: SparkSession, folder: str, target: str) -> None:
    """One local file, without a last line end, from a folder of parts; for tools that need the exact name."""
    parts = spark.read.option("lineSep", "\n").text(folder)
    with open(target, "w", encoding="utf-8", newline="") as f:
        for k, r in enumerate(with_line_order(spark, folder).orderBy("idx").select("value").toLocalIterator()) if parts.head(1) else ():
            f.write(("\n" if k else "") + r[0])
