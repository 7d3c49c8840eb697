"""Broadcasting only what has been measured, and spreading rows that are about to grow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest table that is shipped whole to every executor.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its rows measure at most ``max_bytes``, else as it came.

    The optimiser has no size for the result of joins and Python functions and would shuffle
    the big side by a skewed key. So the rows are measured, and a small table is fetched
    once and handed on as local rows. Without the mark Spark joins by shuffle, where
    AQE splits skewed partitions.
    """
    kept = df.persist()  # measured, then fetched: worked out once
    try:
        width = F.length(F.to_json(F.struct(*df.columns))) + 16
        size = kept.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
        if size > max_bytes:
            return df
        rows = df.sparkSession.createDataFrame(kept.toArrow(), df.schema)
        return F.broadcast(rows)
    finally:
        kept.unpersist()


def fetch_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> pa.Table | None:
    """The rows of ``df`` if they measure at most ``max_bytes``, else nothing."""
    kept = df.persist()
    try:
        width = F.length(F.to_json(F.struct(*df.columns))) + 16
        size = kept.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
        return kept.toArrow() if size <= max_bytes else None
    finally:
        kept.unpersist()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over ``spark.sql.shuffle.partitions`` tasks by a hash of ``columns``.

    For small rows that unfold into many: the number is given, because AQE would merge
    partitions by the few bytes they have before they unfold.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *columns)
