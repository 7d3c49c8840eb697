"""Checking files against a manifest of sizes and checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.functions.text import parent_dir
from poolsift.operators.sizing import spread
from poolsift.sources.storage import entries, locate, open_input

#: Bytes read at a time, and bytes of one range of a tree digest.
READ_BYTES = 8 << 20
RANGE_BYTES = 256 << 20


def files_of(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, size`` of all files under a folder, empty ones too (which Spark's own listing leaves out).

    The driver lists the folder itself; the folders in it are listed by tasks.
    """
    base = folder.rstrip("/") if ":" in folder else f"file:{folder.rstrip('/')}"
    place = locate(folder)[1].rstrip("/")
    top = entries(folder)
    own = [(f"{base}/{e.base_name}", e.size) for e in top if e.is_file and fnmatch(e.base_name, glob)]
    inner = [(e.base_name,) for e in top if not e.is_file]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, _ = locate(folder)
                found = system.get_file_info(fs.FileSelector(f"{place}/{name}", recursive=True))
                found = [f for f in found if f.is_file and fnmatch(f.base_name, glob)]
                paths = [base + f.path[f.path.index(place) + len(place) :] for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([f.size for f in found], pa.int64())], ["path", "size"])

    here = spark.createDataFrame(own, "path string, size long")
    if not inner:
        return here
    below = spark.createDataFrame(inner, "name string").repartition(min(len(inner), 1024))
    return here.unionAll(below.mapInArrow(walk, "path string, size long"))


def _digest(path: str, low: int, high: int) -> str:
    """SHA-256 of a byte range, with a few megabytes in memory."""
    sha = hashlib.sha256()
    with open_input(path) as file:
        file.seek(low)
        while low < high:
            part = file.read(min(READ_BYTES, high - low))
            if not part:
                raise EOFError(f"{path} ends before {high}")
            sha.update(part)
            low += len(part)
    return sha.hexdigest()


def _digested(ranges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digest(*row) for row in zip(*(c.to_pylist() for c in batch.select(["path", "low", "high"]).columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "sha256"])

    return spread(ranges, "path", "low").mapInArrow(run, "path string, size long, low long, high long, sha256 string")


def checksums(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, size, sha256`` of the files under a folder, whatever their size.

    This digest of a file, the one manifests hold, is sequential, so a file is read by one task; see :func:`tree_checksums`.
    """
    files = files_of(spark, folder, glob)
    return _digested(files.select("path", "size", F.lit(0).cast("bigint").alias("low"), F.col("size").alias("high"))).select("path", "size", "sha256")


def tree_checksums(spark: SparkSession, folder: str, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, size, tree_sha256``: the SHA-256 over the digests of a file's ranges in order, for manifests of one's own.

    Ranges of a large file are read by different tasks. The digest depends on ``range_bytes``.
    """
    files = files_of(spark, folder, glob)
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    ranges = files.select("path", "size", F.explode(starts).alias("low"))
    ranges = ranges.withColumn("high", F.least(F.col("low") + range_bytes, "size"))
    listed = _digested(ranges).groupBy("path", "size").agg(F.array_sort(F.collect_list(F.struct("low", "sha256"))).alias("_parts"))
    return listed.select("path", "size", F.sha2(F.array_join("_parts.sha256", ""), 256).alias("tree_sha256"))


def audit_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every path of either side with its ``status``.

    ``missing``, ``unexpected``, ``size_mismatch``, ``hash_mismatch`` or ``ok``; an expected size or
    hash of NULL is not checked.
    """
    expected = manifest.select(
        "path", F.col("size").alias("_size"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_listed")
    )
    differs = lambda have, want: want.isNotNull() & (have != want)
    status = (
        F.when(F.col("_listed").isNull(), "unexpected")
        .when(F.col("_present").isNull(), "missing")
        .when(differs(F.col("size"), F.col("_size")), "size_mismatch")
        .when(differs(F.col("sha256"), F.lower("_sha256")), "hash_mismatch")
        .otherwise("ok")
    )
    present = files.select("path", "size", "sha256", F.lit(True).alias("_present"))
    return present.join(expected, "path", "full").select("path", "size", status.alias("status"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes per folder."""
    return files.groupBy(parent_dir(F.col("path")).alias("dir")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )
