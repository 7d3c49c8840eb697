"""Parquet, CSV, JSON and text tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift import schema
from poolsift.functions.ids import canonical_uid
from poolsift.functions.text import path_stem
from poolsift.sources.storage import open_input


def _parquet(spark: SparkSession, path: str, recursive: bool):
    reader = spark.read.option("pathGlobFilter", "*.parquet*")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.parquet(*path.split("::"))


def scan_pool(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, recursive: bool = False
) -> DataFrame:
    """Pool metadata: the parquet files of a folder, pruned to ``columns``.

    ``a::b::c`` reads several folders, ``recursive`` their sub-folders too. Only names with
    ``.parquet`` are read. Columns that are asked for must exist.
    """
    df = _parquet(spark, path, recursive)
    if columns is None:
        return df
    return schema.require(df, *columns).select(*columns)


def scan_pool_positions(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The same with the place of each row: ``file_stem``, ``row_idx``, and the archive with its vector, ``vector_path``."""
    df = schema.require(_parquet(spark, path, False), *columns)
    return df.select(
        path_stem(F.col("_metadata.file_name")).alias("file_stem"),
        F.col("_metadata.row_index").alias("row_idx"),
        F.regexp_replace(F.col("_metadata.file_path"), r"\.parquet[^/]*$", ".npz").alias("vector_path"),
        *columns,
    )


def scan_first_files(spark: SparkSession, path: str, count: int) -> DataFrame:
    """Only the first ``count`` parquet files of a folder by name; the others are never opened."""
    names = list_files(spark, path, "*.parquet").select("path").orderBy("path").limit(count)
    return spark.read.parquet(*[r.path for r in names.collect()])


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """``uid, face_bboxes`` with canonical ids."""
    df = scan_pool(spark, path, ["uid", "face_bboxes"])
    return df.select(canonical_uid(F.col("uid")).alias("uid"), "face_bboxes")


def union_sources(tables: Mapping[str, DataFrame], name: str = "source") -> DataFrame:
    """Bag union of several tables with the name of the one each row came from."""
    parts = [df.withColumn(name, F.lit(label)) for label, df in tables.items()]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: trimmed lines of text files, blank ones dropped."""
    trimmed = spark.read.text(path).select(F.trim("value").alias("value"))
    return trimmed.filter("value <> ''")


def lines_per_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each text file, such as the split lists of a dataset."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def read_entity_ids(spark: SparkSession, path: str) -> DataFrame:
    """``synset_offset`` from lines such as ``n01440764`` (first letter dropped)."""
    return read_lines(spark, path).select(
        F.substring("value", 2, 32).cast("int").alias("synset_offset")
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV for use outside; between stages use parquet, which loses nothing."""
    df.write.mode("overwrite").option("header", True).option("escape", "\\").option(
        "quoteAll", True
    ).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines (JSON Lines) with their dynamic metrics in a map.

    ``seq`` orders the lines of append-only files: file modification time, then file,
    then place in the file.
    """
    df = spark.read.schema(schema.RESULTS).json(path)
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_modification_time").alias("at"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
    )


def append_results(results: DataFrame, path: str) -> None:
    """Add result lines to a folder of JSON Lines files."""
    results.select("key", "dataset", "metrics").write.mode("append").json(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task registry (a small YAML file that maps task keys to their fields)."""
    import yaml

    with open_input(path) as file:
        entries = yaml.safe_load(file)
    rows = [
        (
            key,
            task.get("name", key),
            task.get("size"),
            task.get("main_metric", "acc1"),
            task.get("num_classes"),
            task.get("random_score"),
            task.get("tags") or [],
        )
        for key, task in entries.items()
    ]
    return spark.createDataFrame(rows, schema.TASKS)


def read_shard_sidecars(spark: SparkSession, folder: str, suffix: str = "_stats.json") -> DataFrame:
    """``shard_name, size`` from statistics files whose archive exists next to them."""
    names = F.col("_metadata.file_name")
    stats = (
        spark.read.schema(schema.SHARD_STATS)
        .option("multiLine", True)
        .option("pathGlobFilter", f"*{suffix}")
        .json(folder)
        .select(
            F.regexp_replace(names, f"\\Q{suffix}\\E$", ".tar").alias("shard_name"),
            F.col("successes").alias("size"),
        )
    )
    archives = list_files(spark, folder, "*.tar").select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("shard_name")
    )
    return stats.join(archives, "shard_name", "left_semi")


def read_cached_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``shard_name, size`` from one JSON object that maps names to sizes."""
    sizes = F.from_json("value", T.MapType(T.StringType(), T.LongType()))
    return spark.read.text(path, wholetext=True).select(
        F.explode(sizes).alias("shard_name", "size")
    )


def write_failed(outcomes: DataFrame, path: str) -> None:
    """Error side file: the failed rows as JSON Lines."""
    outcomes.filter("status = 'failed'").write.mode("overwrite").json(path)


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``path, length, modificationTime`` of files; their content is never read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.load(path).select("path", "length", "modificationTime")


def write_joined_shards(joined: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard in a single job.

    ``rebalance`` gathers small shards into one file each and lets AQE split a large one.
    """
    joined.hint("rebalance", shard).write.mode("overwrite").partitionBy(shard).parquet(path)
