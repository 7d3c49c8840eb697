"""Joining shard rows with pool metadata and face boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsift.functions.text import base_name, parent_dir
from poolsift.schema import BLUR_MAP


def distinct_uids(*tables: DataFrame) -> DataFrame:
    """Distinct ids over any number of tables (combined per task before the shuffle)."""
    first, *rest = [t.select("uid") for t in tables]
    for other in rest:
        first = first.unionByName(other)
    return first.distinct()


def reduce_metadata(metadata: DataFrame, *shard_tables: DataFrame) -> DataFrame:
    """Metadata rows whose id occurs in some shard."""
    return metadata.join(distinct_uids(*shard_tables), "uid", "left_semi")


def join_metadata(shard_rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every shard row with its metadata, ``meta_uid`` NULL and ``matched`` false without any.

    Metadata columns whose name a shard column already has get the prefix ``meta_``. An
    id that occurs several times in the metadata gives as many rows.
    """
    taken = set(shard_rows.columns) | {"uid"}
    renamed = metadata.select(
        *[F.col(c).alias(f"meta_{c}" if c in taken else c) for c in metadata.columns]
    )
    joined = shard_rows.join(renamed, F.col("uid") == F.col("meta_uid"), "left")
    return joined.withColumn("matched", F.col("meta_uid").isNotNull())


def match_rate(joined: DataFrame) -> DataFrame:
    """One row: rows, rows with metadata, and their percentage (NULL without rows)."""
    return joined.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("meta_uid").alias("matched_rows")
    ).withColumn(
        "matched_percent",
        F.try_divide(F.col("matched_rows").cast("double") * 100.0, F.col("total_rows").cast("double")),
    )


def join_by_position(metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """Row i of a metadata file with row i of the vector file of the same stem."""
    return metadata.join(vectors, ["file_stem", "row_idx"])


def position_mismatch(metadata: DataFrame, vectors: DataFrame) -> DataFrame:
    """Files whose metadata and vector files do not have the same number of rows.

    ``vectors`` has a row per vector, or ``vector_rows`` per file.
    """
    per_file = lambda df, name: df.groupBy("file_stem").agg(F.count(F.lit(1)).alias(name))
    counted = vectors if "vector_rows" in vectors.columns else per_file(vectors, "vector_rows")
    both = per_file(metadata, "metadata_rows").join(counted, "file_stem", "full")
    counts = both.select(
        "file_stem",
        F.coalesce("metadata_rows", F.lit(0)).alias("metadata_rows"),
        F.coalesce("vector_rows", F.lit(0)).alias("vector_rows"),
    )
    return counts.filter("metadata_rows <> vector_rows")


def attach_boxes(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """Samples with ``face_bboxes`` (NULL when none are known) and ``box_missing``.

    A sample whose box list is empty has nothing to attach but is not missing. Ids that
    occur more than once among the boxes contribute one list, the smallest.
    """
    known = boxes.groupBy("uid").agg(F.min("face_bboxes").alias("_boxes"))
    return (
        samples.join(known, "uid", "left")
        .withColumn("box_missing", F.col("_boxes").isNull())
        .withColumn("face_bboxes", F.when(F.size("_boxes") > 0, F.col("_boxes")))
        .drop("_boxes")
    )


def inject_boxes(samples: DataFrame, json: str = "json", boxes: str = "face_bboxes") -> DataFrame:
    """Write the boxes into the sample's JSON text under ``face_bboxes``; others stay as they are.

    All other fields pass through as variant values, numbers and nesting unchanged.
    """
    fields = F.from_json(json, T.MapType(T.StringType(), T.VariantType()))
    others = F.map_filter(fields, lambda k, _: k != "face_bboxes")
    added = F.create_map(F.lit("face_bboxes"), F.parse_json(F.to_json(F.col(boxes))))
    written = F.to_json(F.map_concat(others, added))
    has_boxes = F.col(boxes).isNotNull() & (F.size(boxes) > 0)
    return samples.withColumn(json, F.when(has_boxes, written).otherwise(F.col(json)))


def invert_blur_map(maps: DataFrame, text: str = "value", input_dir: str | None = None) -> DataFrame:
    """``shard_name, parquet`` from JSON texts that list the shards of each parquet file.

    Shards in other folders than ``input_dir`` are left out; where two entries list the same
    shard, the later one wins.
    """
    entries = maps.select(F.from_json(text, BLUR_MAP).alias("_map"))
    listed = entries.select(F.posexplode(F.map_values("_map")).alias("_entry", "e")).select(
        F.col("e.parquet").alias("parquet"), "_entry", F.posexplode("e.shards").alias("_place", "path")
    )
    return invert_blur_entries(
        listed.select(F.struct("_entry", "_place").alias("entry"), "path", "parquet"), input_dir
    )


def invert_blur_entries(listed: DataFrame, input_dir: str | None = None) -> DataFrame:
    """The same from a table ``entry, path, parquet`` with one row per listed shard."""
    if input_dir is not None:
        listed = listed.filter(parent_dir(F.col("path")) == input_dir.rstrip("/"))
    return listed.groupBy(base_name(F.col("path")).alias("shard_name")).agg(
        F.max_by("parquet", "entry").alias("parquet")
    )
