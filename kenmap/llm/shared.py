"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kenmap.plans.storage import kept


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to the cluster's checkpoint folder: later stages read it and survive lost executors."""
    return kept(df)


def release() -> None:
    """Free the memos that other operators left in this Python worker, which runs the tasks of one after the other."""
    for module, holder in (("token_ids", "token_ids"), ("bpe", "codec")):
        found = sys.modules.get(f"kenmap.llm.{module}")
        if found is not None:
            getattr(found, holder).cache_clear()
    gc.collect()  # also what the task before left in reference cycles
    give_back()


def give_back() -> None:
    """Give freed memory back to the system: Arrow's pool and the C library else keep it, while a worker waits for the stages that need none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let at most ``rows`` texts go to a Python worker at a time: whole texts are long, and both sides of the pipe hold a batch.

    The setting is the session's, as Spark has no other place for it; it stays lowered, because plans run later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
