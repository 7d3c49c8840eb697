"""Jobs on pool metadata: filter to a subset, profile, join with shards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.functions.text import path_stem
from poolsift.operators.filters import (
    SCORE_COLUMNS,
    FilterInputs,
    FilterSpec,
    apply_filter,
    caption_filter,
    keyword_filter,
    no_filter,
)
from poolsift.operators.metadata import (
    join_metadata,
    match_rate,
    position_mismatch,
    reduce_metadata,
)
from poolsift.operators.profile import length_hist, score_hist
from poolsift.operators.sampling import sample_with_replacement
from poolsift.operators.subsets import sorted_subset
from poolsift.sources.subset_files import write_subset
from poolsift.sources.tables import scan_pool, scan_pool_positions, write_joined_shards
from poolsift.sources.vector_files import attach_vectors, npz_lengths


def curate(pool: DataFrame, spec: FilterSpec, side: FilterInputs | None = None) -> DataFrame:
    """Ids of the samples that pass the filter, ascending, duplicates kept."""
    return sorted_subset(apply_filter(pool, spec, side))


def curate_to(pool: DataFrame, spec: FilterSpec, path: str, side: FilterInputs | None = None) -> None:
    """The same, written as a parquet table in id order (one sorted range per file)."""
    curate(pool, spec, side).write.mode("overwrite").parquet(path)


def curate_to_subset_file(
    pool: DataFrame, spec: FilterSpec, path: str, side: FilterInputs | None = None
) -> None:
    """The same, written as packed 16-byte records for tools that read subset files."""
    write_subset(apply_filter(pool, spec, side), path)


def pool_positions(
    spark: SparkSession, metadata_dir: str, columns: Sequence[str], key: str = "l14_img"
) -> DataFrame:
    """Metadata rows with the place of their vectors, for :func:`~poolsift.sources.vector_files.attach_vectors`.

    Files whose row counts differ from their archive's end the job: a row would get another one's vector.
    Counts come from footers and headers.
    """
    rows = scan_pool_positions(spark, metadata_dir, columns)
    if wrong := position_mismatch(rows, npz_lengths(spark, metadata_dir, key)).take(5):
        listed = ", ".join(f"{r.file_stem}: {r.metadata_rows} rows, {r.vector_rows} vectors" for r in wrong)
        raise ValueError(f"metadata and vectors differ in length ({listed})")
    return rows


def pool_with_vectors(
    spark: SparkSession, metadata_dir: str, columns: Sequence[str], key: str = "l14_img", keep: Callable[[DataFrame], DataFrame] = no_filter
) -> DataFrame:
    """The metadata rows that ``keep`` leaves, with the vector at the same place of the archive of the same name."""
    return attach_vectors(keep(pool_positions(spark, metadata_dir, columns, key)), key)


def training_rows(
    pool: DataFrame, caption_filtering: bool = True, sample_ratio: float = -1.0, seed: int = 0
) -> DataFrame:
    """Rows whose vectors to cluster: optionally only well-captioned samples, and a share per file."""
    kept = caption_filter(pool) if caption_filtering else pool
    return sample_with_replacement(kept, "file_stem", sample_ratio, seed)


def profile_to(pool: DataFrame, terms: Sequence[str], path: str) -> dict[str, DataFrame]:
    """Keep captions with a keyword, write them once, and describe them.

    Returns the length and score histograms of the written rows.
    """
    columns = ["text", *SCORE_COLUMNS.values()]
    keyword_filter(pool.select(*columns), terms).write.mode("overwrite").parquet(path)
    matched = pool.sparkSession.read.parquet(path)
    return {
        "length": length_hist(matched),
        **{arch: score_hist(matched, column) for arch, column in SCORE_COLUMNS.items()},
    }


def join_shards_to(shards_dir: str, metadata_dir: str, path: str, spark: SparkSession) -> DataFrame:
    """Shard tables with their metadata, one folder per shard; returns the match rate."""
    shard = path_stem(F.col("_metadata.file_name")).alias("shard")
    rows = spark.read.parquet(shards_dir).select("*", shard)
    metadata = reduce_metadata(scan_pool(spark, metadata_dir), rows)
    write_joined_shards(join_metadata(rows, metadata), path)
    return match_rate(spark.read.parquet(path))
