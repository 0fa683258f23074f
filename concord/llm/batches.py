"""Bounds on the memory of Python workers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch that goes to or comes from a Python worker; a single longer row is a batch of its own.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES: either side holds several copies of one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key) or "").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(f: Callable) -> Callable:
    """A map over batches that gives its worker's free memory back at the end of a task; workers live on."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def slices(batch: pa.RecordBatch, size: int = 1 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about that many bytes of text, or a single row."""
    text = batch.column(column)
    ends = np.cumsum([x.as_buffer().size if x.is_valid else 0 for x in text])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield batch.slice(at, to - at)
        at = to
