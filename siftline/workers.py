"""Python workers and this package."""

from __future__ import annotations

import ctypes
import gc
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Put this package on the Python workers' path. (A cluster has it there already, by --py-files or installed.)"""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores, for work that is large beside a row's bytes: a file of many small rows is read by a few tasks, or one."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def give_back() -> None:
    """Return memory that a finished task has freed to the system: workers are reused, and allocators would keep it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
