"""Shards plus subset to new shards."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.functions.ids import canonical_uid, sample_key, seeded_hex
from poolsift.operators.layout import (
    assign_shards_by_size,
    coarse_hex,
    exclusive_running_sum,
    hex_bucket,
    ordinals,
    range_bucket,
)
from poolsift.operators.metadata import attach_boxes
from poolsift.operators.sizing import spread
from poolsift.operators.subsets import copy_blocks, subset_counts, unfold_copies
from poolsift.sources.storage import refuse_or_clear, write_text
from poolsift.sources.tars import SOURCE, copy_samples, index_samples, shard_number

NAME_FORMAT = "{:08d}.tar"
#: Full shards of samples that one run of the byte-limited layout goes through.
SHARDS_PER_RUN = 16
#: Neighbouring samples of an input shard that stay together in a shuffled plan; their order is drawn when they are written.
SHUFFLE_RUN = 256


@dataclass(frozen=True)
class ReshardReport:
    processed_count: int
    unreadable_count: int
    requested_count: int
    output_count: int
    failed_count: int
    boxes_missing_count: int
    output_shard_count: int
    output_shard_format: str


def plan_copies(
    index: DataFrame,
    subset: DataFrame,
    shard_size: int = 10_000,
    max_bytes: float | None = None,
    shuffle_seed: int | None = None,
    boxes: DataFrame | None = None,
) -> DataFrame:
    """Where every copy of every kept sample goes: ``shard_id, position`` and its source.

    Works on ids and places of members alone. Copies are numbered in input order, or in a seeded
    order of runs of :data:`SHUFFLE_RUN` neighbours, so an output shard takes from few input shards. Without a byte limit shards are filled exactly. With one, runs of samples
    are filled one after the other and each run may leave its last shard partly filled.
    """
    kept = (
        index.filter("error IS NULL")
        .withColumn("uid", canonical_uid(F.col("uid")))
        .join(subset_counts(subset), "uid")
        .select("uid", "copies", "shard", "sample_idx", "bytes", *SOURCE)
    )
    if boxes is not None:
        kept = attach_boxes(kept, boxes).withColumn("boxes_json", F.to_json("face_bboxes"))
        kept = kept.drop("face_bboxes")
    if shuffle_seed is None:
        # Input order: add up copies per sample, so a sample with many copies stays one row.
        place = F.struct("shard", range_bucket(F.col("sample_idx")).alias("part"))
        started = exclusive_running_sum(
            kept, ["shard", "sample_idx"], "copies", "_first", bucket=place
        )
        blocks = spread(copy_blocks(started), "shard", "sample_idx", "_low")
        numbered = unfold_copies(blocks).withColumn(
            "_ordinal", F.col("_first") + F.col("copy")
        )
    else:
        blocks = spread(copy_blocks(kept), "shard", "sample_idx", "_low")
        drawn = unfold_copies(blocks).withColumn(
            "_order",
            seeded_hex(shuffle_seed, F.col("shard"), F.floor(F.col("sample_idx") / F.lit(SHUFFLE_RUN)), F.col("copy")),
        )
        numbered = ordinals(
            drawn,
            hex_bucket(F.col("_order")),
            ["_order", "shard", "sample_idx", "copy"],
            output="_ordinal",
            coarse=coarse_hex,
        )
    numbered = numbered.withColumn("key", sample_key(F.col("uid"), F.col("copy")))
    if max_bytes is None:
        placed = numbered.withColumn(
            "shard_id", F.floor(F.col("_ordinal") / F.lit(shard_size)).cast("bigint")
        )
    else:
        writers = numbered.withColumn(
            "_writer", F.floor(F.col("_ordinal") / F.lit(SHARDS_PER_RUN * shard_size))
        )
        placed = assign_shards_by_size(
            writers, "_writer", ["_ordinal"], "bytes", shard_size, max_bytes
        )
    extra = ["boxes_json", "box_missing"] if boxes is not None else []
    return placed.select(
        "shard_id",
        F.col("_ordinal").alias("position"),
        *["key", "uid", "shard", "sample_idx", "copy", "bytes"],
        *SOURCE,
        *extra,
    )


def reshard(
    spark: SparkSession,
    input_dir: str,
    subset: DataFrame,
    output_dir: str,
    shard_size: int = 10_000,
    max_bytes: float | None = None,
    shuffle_seed: int | None = None,
    boxes: DataFrame | None = None,
    index: DataFrame | None = None,
    edit: Callable | None = None,
    overwrite: bool = False,
    first_shard: int = 0,
    num_shards: int | None = None,
) -> ReshardReport:
    """Write the chosen samples as new shards with statistics files and ``meta.json``.

    A folder that is not empty is refused, or cleared first with ``overwrite``: shards of
    an earlier, larger run must not stay among the new ones. ``first_shard`` and ``num_shards``
    take the input shards with these numbers in their names.
    The index and the plan are written next to the output and read back, so the copy
    stage restarts from files when executors are lost.
    """
    refuse_or_clear(output_dir, overwrite)
    if index is None:
        found = index_samples(spark, input_dir, first_shard, num_shards)
        found.write.mode("overwrite").parquet(f"{output_dir}/_index")
        index = spark.read.parquet(f"{output_dir}/_index")
    elif first_shard or num_shards is not None:
        number = shard_number(F.col("shard"))
        index = index.where(number >= first_shard)
        index = index if num_shards is None else index.where(number < first_shard + num_shards)
    plan_copies(index, subset, shard_size, max_bytes, shuffle_seed, boxes).write.mode(
        "overwrite"
    ).parquet(f"{output_dir}/_plan")
    plan = spark.read.parquet(f"{output_dir}/_plan")
    boxless = F.count_if("box_missing") if boxes is not None else F.lit(0)
    planned = plan.agg(F.max("shard_id").alias("last"), boxless.alias("boxless")).first()
    last = planned.last
    written = copy_samples(plan, output_dir, 0 if last is None else last + 1, NAME_FORMAT, edit, mix=shuffle_seed)

    read = index.agg(
        F.count_if(F.col("error").isNull()).alias("good"),
        F.count_if(F.col("error").isNotNull()).alias("bad"),
    ).first()
    out = written.agg(
        F.coalesce(F.sum("successes"), F.lit(0)).alias("samples"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.count(F.lit(1)).alias("shards"),
    ).first()
    report = ReshardReport(
        processed_count=read.good,
        unreadable_count=read.bad,
        requested_count=subset.count(),
        output_count=out.samples,
        failed_count=out.failed,
        boxes_missing_count=planned.boxless,
        output_shard_count=out.shards,
        output_shard_format=NAME_FORMAT,
    )
    write_text(f"{output_dir}/meta.json", json.dumps(asdict(report)))
    return report
