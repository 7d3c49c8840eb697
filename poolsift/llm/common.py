"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.session import run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage: what follows does not work ``df`` out again, and a lost executor
    costs nothing that was finished before.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(text, F.lit(""))


def text_parts(batch: pa.RecordBatch, place: int, most: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """Rows ``low`` to ``high`` of a batch with their texts, at most ``most`` bytes at a time.

    A longer text stands alone. Only the part at hand is held as Python strings.
    """
    column = batch.column(place)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, side="right")) - 1)
        yield low, high, column.slice(low, high - low).to_pylist()
        low = high


#: Allocations of at least so many bytes are returned to the system when they are freed.
OWN_PAGES = 1 << 20


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for ``mapInArrow``, in a task that gives its memory back.

    Python workers live on from task to task and from stage to stage. Large arrays get pages of their own, so freeing
    one shrinks the worker; at the end of a task what the function still holds goes, and the allocators let go of the rest.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = None
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such settings
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, OWN_PAGES)  # M_MMAP_THRESHOLD
            libc.malloc_trim
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if libc is not None:
                with contextlib.suppress(AttributeError):
                    libc.malloc_trim(0)

    return task
