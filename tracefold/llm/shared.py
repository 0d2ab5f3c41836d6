"""What Python workers are given and hold, and intermediate tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import staging
from ..staging import stage as stage

#: Rows sent to a Python worker at once; a row may be a very long text.
BATCH = 2048
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_broadcasts: list = []


def share(spark: SparkSession, value):
    """A broadcast that ``release`` takes off the executors; they fetch it again should it still be asked for."""
    found = spark.sparkContext.broadcast(value)
    _broadcasts.append(found)
    return found


def _give_back() -> None:
    """Return freed memory to the system: workers are kept, and so would be what they once took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH`` rows, whose workers give their memory back after each task."""
    spark = df.sparkSession
    rows = int(spark.conf.get(_BATCH_SETTING))
    if rows <= 0 or rows > BATCH:
        spark.conf.set(_BATCH_SETTING, str(BATCH))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(task, schema)


def mark() -> tuple[int, int]:
    """The point up to which ``release`` keeps what there is."""
    return staging.mark(), len(_broadcasts)


def release(since: tuple[int, int], until: tuple[int, int]) -> None:
    """Delete the tables staged between two marks, and take the broadcasts made there off the executors."""
    staging.release(since[0], until[0])
    values = _broadcasts[since[1] : until[1]]
    _broadcasts[since[1] : until[1]] = [None] * len(values)
    for value in filter(None, values):
        value.unpersist()
