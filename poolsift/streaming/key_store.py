"""The keys that are done, in hash buckets on shared storage.

A batch reads the buckets its own keys fall into and no others. Buckets are kept small: when the keys outgrow them, the store
moves to a new generation with more buckets, so what a batch reads depends on the batch and not on the keys of all earlier
ones. A bucket that has gathered many small files is written anew as one by the batch that touches it.

Keys are a set with the batch that added them, so writing some twice (a batch that is replayed, a merge that broke off)
changes nothing; the generation in use is named by one small file that is replaced in one move.
"""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.sources.storage import drop_dir, entries, locate, open_input, write_text

LAYOUT = "_layout.json"


class KeyStore:
    """``folder/gen=<generation>/bucket=<number>/*.parquet`` with the columns ``key`` and ``batch``."""

    def __init__(
        self, spark: SparkSession, folder: str, kind: T.DataType, per_bucket: int = 50_000, most_files: int = 16, first_buckets: int = 16
    ) -> None:
        self.spark, self.folder, self.per_bucket, self.most_files = spark, folder, per_bucket, most_files
        self.schema = T.StructType([T.StructField("key", kind), T.StructField("batch", T.LongType())])
        if any(e.base_name == LAYOUT for e in entries(folder)):
            with open_input(posixpath.join(folder, LAYOUT)) as file:
                self.layout = json.load(file)
        else:
            self.layout = {"generation": 0, "buckets": first_buckets, "keys": 0}
        #: Bytes of the files that the last batch read.
        self.bytes_read = 0

    def _generation(self, number: int) -> str:
        return posixpath.join(self.folder, f"gen={number}")

    def _bucket_dir(self, bucket: int) -> str:
        return posixpath.join(self._generation(self.layout["generation"]), f"bucket={bucket}")

    def bucketed(self, keys: DataFrame, buckets: int | None = None) -> DataFrame:
        return keys.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets or self.layout["buckets"])).cast("int"))

    def without_seen(self, rows: DataFrame, key: str, batch: int) -> DataFrame:
        """``rows`` (one per key) whose keys no earlier batch has added."""
        touched = [r.bucket for r in self.bucketed(rows.select(F.col(key).alias("key"))).select("bucket").distinct().collect()]
        files = {b: [e for e in entries(self._bucket_dir(b)) if e.is_file and e.base_name.endswith(".parquet")] for b in touched}
        self.bytes_read = sum(e.size for found in files.values() for e in found)
        paths = [self._bucket_dir(b) for b, found in files.items() if found]
        if not paths:
            return rows
        self._merge({b: found for b, found in files.items() if len(found) > self.most_files})
        done = self.spark.read.schema(self.schema).parquet(*paths).where(F.col("batch") < batch)
        return rows.join(done.select(F.col("key").alias(key)).distinct(), key, "left_anti")

    def _merge(self, crowded: dict[int, list]) -> None:
        """Buckets with many files as one file each; the old files go once the new ones are there."""
        for bucket, found in crowded.items():
            folder = self._bucket_dir(bucket)
            rows = self.spark.read.schema(self.schema).parquet(folder).groupBy("key").agg(F.min("batch").alias("batch"))
            rows.coalesce(1).write.mode("append").parquet(folder)
            system, _ = locate(folder)
            for entry in found:
                system.delete_file(entry.path)

    def add(self, keys: DataFrame, batch: int) -> None:
        """Add ``keys`` (one column) as done by ``batch``; grow the store where they no longer fit."""
        rows = keys.toDF("key").withColumn("batch", F.lit(batch).cast("bigint")).persist()
        try:
            self._write(self.bucketed(rows), self.layout["generation"], "append")
            count = self.layout["keys"] + rows.count()
        finally:
            rows.unpersist()
        old, buckets = self.layout["generation"], self.layout["buckets"]
        while count > buckets * self.per_bucket:
            buckets *= 4
        if buckets > self.layout["buckets"]:
            everything = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self._generation(old))
            everything = everything.groupBy("key").agg(F.min("batch").alias("batch"))
            self._write(self.bucketed(everything, buckets).repartition("bucket"), old + 1, "overwrite")
        generation = old + (buckets > self.layout["buckets"])
        self.layout = {"generation": generation, "buckets": buckets, "keys": count}
        write_text(posixpath.join(self.folder, LAYOUT), json.dumps(self.layout))
        if generation != old:
            drop_dir(self._generation(old))

    def _write(self, rows: DataFrame, generation: int, mode: str) -> None:
        # a bucket's keys go to one file, so a batch adds one file per bucket at most
        rows.repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(self._generation(generation))
