"""Memory of the Python workers, which Spark keeps from task to task and from stage to stage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def tidy(apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``apply`` for mapInArrow; after its last batch, what the task's arrays and batches left free in the worker goes
    back to the system. An idle worker would hold it else, beside the executor, through stages without Python."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from apply(batches)
        release()

    return run


def release() -> None:
    """Give free memory of Arrow and, where the C library can, of malloc back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
