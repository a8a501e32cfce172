"""Session helpers of the training-data operators: tables, batch sizes and what workers keep."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import discard, shared_dir, stash  # noqa: F401 (used by the operators)
from ..operators.sizing import BATCH_ROWS, small_batches, spread  # noqa: F401 (used by the operators)

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def per_worker(key: str, make):
    """A value made once per worker process: it outlives the task."""
    home = sys.modules.setdefault("_marlstone_worker", types.ModuleType("_marlstone_worker")).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


def give_back() -> None:
    """Empty a worker's caches and return its free memory to the system when a task ends: idle workers stay for a while."""
    for kept in vars(sys.modules.get("_marlstone_worker", types.ModuleType(""))).values():
        if hasattr(kept, "clear"):
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass
