"""Numbering, running totals and shard layout, all without a window over the whole table.

The pattern is the same throughout: rows fall into ordered, bounded buckets; the
table of bucket totals gets an exclusive running sum; each row adds the start of its
bucket to its place inside the bucket. Where there may be many buckets (one per row, at worst), their totals are cut into ranges
themselves, whose totals are one short array per group; so no step sorts a whole table or group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolsift.functions.text import shard_name
from poolsift.session import saved

#: Leading hex digits that make a bucket of a uniformly spread key.
BUCKET_DIGITS = 4
#: Consecutive integers that make a bucket of an integer order key.
BUCKET_WIDTH = 1 << 16


def _exclusive_sum(
    totals: DataFrame,
    within: Sequence[str],
    value: str,
    output: str,
    total: str | None = None,
    coarse: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Sum of ``value`` over all earlier buckets of the group.

    The buckets are put into parts that keep their order: those of ``coarse``, which must have few values, or ranges, as many as
    Spark has tasks. The part totals of a group are one array.
    """
    if coarse is not None:
        parted = totals.withColumn("_part", coarse(F.col("_bucket")))
    else:
        tasks = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = totals.repartitionByRange(tasks, *within, "_bucket")
        # written, since a range must hold the same buckets whenever it is read
        parted = saved(ranged.withColumn("_part", F.spark_partition_id()), "bucket-totals")
    sums = parted.groupBy(*within, "_part").agg(F.sum(value).alias("_sum"))
    listed = sums.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("_part", "_sum"))).alias("_parts"))
    kind = sums.schema["_sum"].dataType
    add = lambda parts: F.aggregate(parts, F.lit(0).cast(kind), lambda x, p: x + F.coalesce(p["_sum"], F.lit(0).cast(kind)))
    earlier = F.transform("_parts", lambda p, i: F.struct(p["_part"].alias("_part"), add(F.slice("_parts", F.lit(1), i)).alias("_earlier")))
    starts = listed.select(*within, add(F.col("_parts")).alias("_parts_sum"), F.explode(earlier).alias("_e")).select(*within, "_parts_sum", "_e._part", "_e._earlier")
    before = W.partitionBy(*within, "_part").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = parted.withColumn("_inside", F.coalesce(F.sum(value).over(before), F.lit(0))).join(starts, [*within, "_part"])
    columns = [(F.col("_earlier") + F.col("_inside")).alias(output)]
    if total is not None:
        columns.append(F.col("_parts_sum").alias(total))
    return placed.select(*within, "_bucket", *columns)


def ordinals(
    df: DataFrame,
    bucket: Column,
    order_by: Sequence[Column | str],
    within: Sequence[str] = (),
    output: str = "ordinal",
    coarse: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """0-based row number in ``order_by`` order, per group of ``within``.

    ``bucket`` must never decrease along ``order_by`` and should cut the rows into many
    pieces of similar size; a group that holds a third of the table is then spread
    over its buckets. Only one count per bucket goes through the running sum. ``coarse`` gives a bucket's
    part, where few parts that keep the order are known (see :func:`coarse_hex`).
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = _exclusive_sum(counts, within, "_n", "_start", coarse=coarse)
    place = F.row_number().over(W.partitionBy(*within, "_bucket").orderBy(*order_by)) - 1
    return (
        keyed.withColumn("_place", place)
        .join(starts, [*within, "_bucket"])
        .withColumn(output, F.col("_start") + F.col("_place"))
        .drop("_bucket", "_place", "_start")
    )


def hex_bucket(key: Column, digits: int = BUCKET_DIGITS) -> Column:
    """Bucket of a uniformly spread lower-case hex key; follows the order of the key."""
    return F.substring(key, 1, digits)


def coarse_hex(bucket: Column) -> Column:
    """One of 256 parts of hex buckets."""
    return F.substring(bucket, 1, 2)


def range_bucket(key: Column, width: int = BUCKET_WIDTH) -> Column:
    """Bucket of an integer key; follows the order of the key."""
    return F.floor(key / F.lit(width))


def exclusive_running_sum(
    df: DataFrame,
    order_by: str | Sequence[str],
    value: str,
    output: str,
    within: Sequence[str] = (),
    bucket: Column | None = None,
    total: str | None = None,
    coarse: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Sum of ``value`` over all earlier rows in ``order_by`` order (unique per group).

    ``bucket`` follows the same order; the default suits one integer column. ``total`` names
    a column for the sum over the whole group, which comes at no extra pass.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    keyed = df.withColumn("_bucket", range_bucket(F.col(order[0])) if bucket is None else bucket)
    totals = keyed.groupBy(*within, "_bucket").agg(F.sum(value).alias("_total"))
    starts = _exclusive_sum(totals, within, "_total", "_start", total, coarse)
    before = W.partitionBy(*within, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(before), F.lit(0))
    return (
        keyed.withColumn("_inside", inside)
        .join(starts, [*within, "_bucket"])
        .withColumn(output, F.col("_start") + F.col("_inside"))
        .drop("_bucket", "_inside", "_start")
    )


def shard_offsets(sizes: DataFrame) -> DataFrame:
    """``shard_id, size`` with ``data_start``, the samples in all shards before it."""
    return exclusive_running_sum(sizes, "shard_id", "size", "data_start")


def shard_totals(sizes: DataFrame) -> DataFrame:
    """One row: how many shards and samples there are."""
    return sizes.agg(
        F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("size"), F.lit(0)).alias("samples")
    )


def balanced_buckets(sizes: DataFrame, buckets: int) -> DataFrame:
    """Shards with ``data_start`` and the ``bucket`` it falls into, of equal runs of samples.

    A shard that starts exactly on a border belongs to the bucket on its right.
    """
    offsets = exclusive_running_sum(sizes, "shard_id", "size", "data_start", total="_all")
    step = F.greatest(F.ceil(F.col("_all") / F.lit(buckets)), F.lit(1))
    return offsets.withColumn("bucket", F.floor(F.col("data_start") / step)).drop("_all")


def assign_shards(
    samples: DataFrame, order_hex: str, shard_size: int, tie_break: Sequence[str] = ()
) -> DataFrame:
    """Samples with ``shard_id`` and ``position``: full shards in the order of a hex key."""
    if shard_size < 1:
        raise ValueError("shard_size must be positive")
    numbered = ordinals(
        samples, hex_bucket(F.col(order_hex)), [order_hex, *tie_break], output="_ordinal", coarse=coarse_hex
    )
    return numbered.select(
        *samples.columns,
        F.floor(F.col("_ordinal") / F.lit(shard_size)).cast("bigint").alias("shard_id"),
        F.pmod("_ordinal", F.lit(shard_size)).cast("int").alias("position"),
    )


def shard_stats(assigned: DataFrame) -> DataFrame:
    """Samples per output shard, the content of the statistics side files."""
    return assigned.groupBy("shard_id").agg(F.count(F.lit(1)).alias("successes"))


def assign_shards_by_size(
    samples: DataFrame,
    writer: str,
    order_by: Sequence[str],
    size: str,
    max_count: int = 100_000,
    max_bytes: float = 3e9,
) -> DataFrame:
    """Samples with a global ``shard_id`` where each writer rolls over when a shard is full.

    A writer starts a new shard before a sample when the current one already has
    ``max_count`` samples or at least ``max_bytes`` bytes, and leaves its last shard partly
    filled. That rule looks back at all earlier samples of the writer, so it runs as a
    pass over its sorted sizes that jumps from border to border in their running sum. Only the order and the
    sizes go through that pass, and one row per output shard comes back. ``balanced_buckets``
    gives writers of bounded size. Shard numbers follow writer order.
    """
    slim = samples.select(writer, F.struct(*order_by).alias("_at"), F.col(size).cast("bigint").alias("_size"))
    ordered = slim.repartition(writer).sortWithinPartitions(writer, "_at")
    borders = ordered.mapInArrow(_borders(max_count, max_bytes), slim.select(writer, "_at").schema)
    listed = borders.groupBy(writer).agg(F.array_sort(F.collect_list("_at")).alias("_firsts"))
    shards = listed.select(writer, F.size("_firsts").cast("bigint").alias("_writer_shards"))
    starts = exclusive_running_sum(shards, writer, "_writer_shards", "_writer_start")
    known = listed.join(starts.select(writer, "_writer_start"), writer)
    behind = F.size(F.filter("_firsts", lambda first: first <= F.struct(*order_by))) - 1
    return samples.join(known, writer).select(*samples.columns, (F.col("_writer_start") + behind).alias("shard_id"))


def _borders(max_count: int, max_bytes: float):
    """The first row of every output shard, from rows (writer, place, size) sorted by writer and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, count, filled = None, 0, 0  # of the open shard
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            ids = codes.indices.to_numpy(zero_copy_only=False)
            sizes = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            firsts = []
            for low, high in zip(cuts[:-1], cuts[1:]):
                name = codes.dictionary[int(ids[low])].as_py()
                upto = np.concatenate([[0], np.cumsum(sizes[low:high])])
                at = 0
                if name != writer:
                    writer, count, filled = name, 0, 0
                    firsts.append(low)
                while True:
                    # rows that go into the open shard: until it has enough of either
                    room = max(0, max_count - count)
                    full = int(np.searchsorted(upto, upto[at] + max_bytes - filled, side="left")) if filled < max_bytes else at
                    end = min(at + room, max(at, full), high - low)
                    end = max(end, at + (count == 0))  # a shard has a row at least
                    count, filled = count + end - at, filled + int(upto[end] - upto[at])
                    at = end
                    if at == high - low:
                        break
                    firsts.append(low + at)
                    count, filled = 0, 0
            yield batch.select([0, 1]).take(pa.array(firsts, pa.int64()))

    return run


def member_islands(
    members: DataFrame,
    shard: str = "shard",
    index: str = "member_idx",
    prefix: str = "prefix",
    width: int = 1 << 20,
) -> DataFrame:
    """Members with ``island``, the 0-based number of their run of equal prefixes.

    ``index`` is the integer position inside a shard. A shard is worked on in ranges of
    ``width`` positions; the ranges are stitched together with one row each (first
    and last prefix, breaks inside), so one huge shard is not one task.
    """
    keyed = members.withColumn("_bucket", range_bucket(F.col(index), width))
    run = W.partitionBy(shard, "_bucket").orderBy(index)
    changed = (F.lag(prefix).over(run) != F.col(prefix)).cast("int")
    marked = keyed.withColumn("_break", F.coalesce(changed, F.lit(0)))
    ranges = marked.groupBy(shard, "_bucket").agg(
        F.min_by(prefix, index).alias("_first"),
        F.max_by(prefix, index).alias("_last"),
        F.sum("_break").alias("_breaks"),
    )
    along = W.partitionBy(shard).orderBy("_bucket")
    seam = F.coalesce((F.lag("_last").over(along) != F.col("_first")).cast("int"), F.lit(0))
    starts = (
        ranges.withColumn("_seam", seam)
        .withColumn("_upto", F.sum(F.col("_breaks") + F.col("_seam")).over(along))
        .select(shard, "_bucket", (F.col("_upto") - F.col("_breaks")).alias("_start"))
    )
    inside = F.sum("_break").over(run.rowsBetween(W.unboundedPreceding, 0))
    return (
        marked.withColumn("_inside", inside)
        .join(starts, [shard, "_bucket"])
        .select(*members.columns, (F.col("_start") + F.col("_inside")).alias("island"))
    )


def shard_sizes(cached: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``shard_name, size``: the cached table wins, side files fill in what it lacks."""
    return (
        cached.select("shard_name", F.col("size").alias("_cached"))
        .join(sidecars.select("shard_name", F.col("size").alias("_sidecar")), "shard_name", "full")
        .select("shard_name", F.coalesce("_cached", "_sidecar").cast("bigint").alias("size"))
        .filter("size IS NOT NULL")
    )


def missing_shards(found: DataFrame, first: int, count: int) -> DataFrame:
    """Expected shard numbers that are not among ``found`` (column ``shard_id``)."""
    expected = found.sparkSession.range(first, first + count).withColumnRenamed("id", "shard_id")
    return expected.join(found.select("shard_id").distinct(), "shard_id", "left_anti")


def shard_range(df: DataFrame, first: int, count: int, shard_id: str = "shard_id") -> DataFrame:
    """Rows of ``count`` shards from ``first`` on; on a partition column this prunes folders."""
    return df.filter(F.col(shard_id).between(first, first + count - 1))


def shard_ranges(names: DataFrame, name: str = "name") -> DataFrame:
    """Brace notation per shard prefix, ``<prefix>{0000..0123}.tar``, from the largest number."""
    stem = F.regexp_replace(F.col(name), r"\.tar$", "")
    parts = names.filter(F.col(name).endswith(".tar")).select(
        F.regexp_extract(stem, r"^(.*?)(\d+)$", 1).alias("prefix"),
        F.regexp_extract(stem, r"(\d+)$", 1).alias("_digits"),
    )
    ranges = (
        parts.filter(F.col("_digits") != "")
        .groupBy("prefix")
        .agg(
            F.max(F.col("_digits").cast("bigint")).alias("last"),
            F.max(F.length("_digits")).alias("_width"),
        )
    )
    padded = lambda c: F.lpad(c.cast("string"), F.col("_width"), F.lit("0"))
    return ranges.select(
        "prefix",
        F.concat(
            "prefix", F.lit("{"), padded(F.lit(0)), F.lit(".."), padded(F.col("last")), F.lit("}.tar")
        ).alias("shard_range"),
    )


def manifest_range(manifest: DataFrame) -> DataFrame:
    """Brace notation of a resharded folder from its manifest row (count and name format)."""
    stem = lambda n: F.regexp_replace(F.format_string("%08d.tar", n), r"\.tar$", "")
    return manifest.select(
        F.concat(
            F.lit("{"),
            stem(F.lit(0).cast("bigint")),
            F.lit(".."),
            stem(F.col("output_shard_count").cast("bigint") - 1),
            F.lit("}.tar"),
        ).alias("shard_range")
    )


def renumber_shards(
    names: DataFrame, name: str = "name", template: str = "%08d.tar", prefix_length: int = 5
) -> DataFrame:
    """Old shard names in name order with their new gap-free names.

    Names that share ``prefix_length`` characters are sorted together (1,000 of the
    usual eight-digit names), so the catalogue is never one sorted group.
    """
    numbered = ordinals(
        names.select(name), F.substring(name, 1, prefix_length), [name], output="new_id"
    )
    return numbered.select(name, "new_id", shard_name(F.col("new_id"), template).alias("new_name"))
