"""Cutting the lineage with tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sieve-ckpt-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables that checkpointed() wrote in it; for work whose results are written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            forget(table)


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes the rows to the checkpoint folder (spark.checkpoint.dir) and returns the table read from there.

    A table survives the loss of executors, is compressed, and has its true size in the plans built on it; a plan
    checkpoint would keep estimates, which multiply with every join of a loop until planning no longer ends. On one
    machine, where no folder is named, a temporary one is set; on a cluster that is an error. Like Spark's own checkpoints, the
    tables stay until the folder is cleaned, but for those that forget() or the end of a scope() removes.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._sieve_path = path
    if _scopes:
        _scopes[-1].append(table)
    return table


def forget(table: DataFrame) -> None:
    """Deletes a table that checkpointed() wrote; nothing may read it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._sieve_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
