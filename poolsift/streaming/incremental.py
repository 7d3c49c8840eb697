"""Filtering new pool files once, and resuming by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from poolsift.streaming.key_store import KeyStore


def read_pool_stream(
    spark: SparkSession,
    path: str,
    columns: T.StructType,
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(columns).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def filter_new_files(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> None:
    """Run a per-row filter over all files not seen yet, then stop.

    The file sink and the checkpoint make each file count exactly once over restarts.
    Only filters with a fixed threshold qualify: a top fraction needs the whole pool.
    """
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def process_once_per_key(
    stream: DataFrame,
    key: str,
    work: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    per_bucket: int = 50_000,
) -> None:
    """Do ``work`` for keys without output yet, over restarts and repeated rows, then stop.

    Finished keys lie in a :class:`~poolsift.streaming.key_store.KeyStore` next to the output, so a batch reads
    only the buckets of its own keys. Every batch has its own folder; a batch that is replayed after a failure replaces its
    folder and only looks at the keys of earlier ones, which keeps the result exactly-once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store = KeyStore(batch.sparkSession, f"{output}/_keys", batch.schema[key].dataType, per_bucket)
        rows = batch.dropDuplicates([key]).persist()
        try:
            fresh = store.without_seen(rows, key, batch_id).persist()
            work(fresh).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
            store.add(fresh.select(key), batch_id)
            fresh.unpersist()
        finally:
            rows.unpersist()

    query = (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
