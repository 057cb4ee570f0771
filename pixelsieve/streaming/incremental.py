"""Keeping only what is not in a growing collection, batch by batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.setops import remain
from ..schema import HashSpec


def accept_into(gallery: str, spec: HashSpec, below: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows ``idx, path, <hash>`` of a batch that are near no row of the gallery are added to it.

    The gallery is a folder of Parquet, one subfolder for each batch, which a repeated batch overwrites, so that a
    restart after a failure adds nothing twice; a batch is compared with the subfolders of earlier batches.
    """
    def accept(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            held = spark.read.parquet(gallery).filter(f"batch < {batch_id}")
        except Exception as e:  # no gallery yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            held = None
        new = batch if held is None else remain(batch, held, spec, below)
        new.write.mode("overwrite").parquet(f"{gallery}/batch={batch_id}")

    return accept
