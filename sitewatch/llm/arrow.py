"""Small helpers of the operators that work on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

# Text bytes a task works on at a time; a longer text is a batch of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *names: str) -> None:
    """Fail early, and by name, when a column that an operator reads is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column in one array, and where each text starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(column.buffers()[1], np.int64)
    starts = starts[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = SLICE_BYTES) -> Iterator:
    """The batch in runs of rows that hold at most ``most`` bytes of ``column`` (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    sizes = np.asarray(sizes.to_numpy(zero_copy_only=False) if isinstance(sizes, pa.Array) else sizes, np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


# The one thing this Python worker keeps from task to task: its owner, its key, and itself.
_resident: tuple[str, Hashable, object] | None = None
# The last task that this worker tidied up for.
_tidied: int | None = None


def resident(owner: str, key: Hashable, make: Callable[[], object]) -> object:
    """What ``make()`` returns, kept in this Python worker for the owner's next tasks.

    Spark hands workers from stage to stage, so what an operator keeps lies beside the work of all
    others. A worker therefore keeps one thing; ``tidy`` for another owner drops it.
    """
    global _resident
    if _resident is None or _resident[:2] != (owner, key):
        _resident = None
        _resident = (owner, key, make())
    return _resident[2]


def release(owner: str = "") -> None:
    """Drop what another owner keeps here, and give memory that is free back to the system."""
    global _resident
    if _resident is not None and _resident[0] != owner:
        _resident = None
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(owner: str = "") -> None:
    """``release`` once for each task, however many groups it has."""
    global _tidied
    context = TaskContext.get()
    task = context.taskAttemptId() if context is not None else None
    if task is None or task != _tidied:
        release(owner)
        _tidied = task


def tidied(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task, with ``release`` before and after it."""

    def tidy_run(batches: Iterator) -> Iterator:
        release(owner)
        try:
            yield from run(batches)
        finally:
            release(owner)

    return tidy_run
