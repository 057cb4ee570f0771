"""Files and decoded images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, min_bytes: int = 0) -> DataFrame:
    """``path, length, content`` of whole files; a least size is pushed into the scan, so smaller files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") >= min_bytes).select("path", "length", "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, height, width, nChannels, data`` (bytes in the order blue, green, red); height is -1 if undecodable."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    return images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def local_path(uri: str = "path"):
    """The path without its scheme, as it stands in a list file."""
    return F.regexp_replace(F.col(uri), r"^file:(//)?(?=/)", "")
