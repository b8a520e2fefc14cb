"""Shared scratch space, and the size of batches of texts."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession

from ..scratch import cut, forget, new_path, remove, shared_dir, store, written

__all__ = ["cut", "forget", "new_path", "release", "remove", "shared_dir", "small_batches", "store", "written"]


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver: of many finished steps it would fill the heap, and a heap once grown is kept."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let texts go to Python by ``rows`` rows at most, unless the session says otherwise than by default.

    Arrow buffers of a batch lie outside the heap, some copies of them on both
    sides; texts of some kilobytes make 10,000 rows too much for small executors.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
