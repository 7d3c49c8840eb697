"""Subsets are multisets of sample ids: how often an id occurs is how often it is emitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsift.functions.ids import canonical_uid, sample_key
from poolsift.operators.sizing import spread

#: Copies of one id that are expanded from a single row.
COPY_BLOCK = 1 << 12
#: The same for rows that are sorted by id first; small, so that ranges of rows stay alike.
SORT_BLOCK = 1 << 6
#: Copies from which on an id is salted in joins, and the most salts it gets.
HOT_COPIES = 1 << 20
MOST_SALTS = 1 << 12


def sorted_subset(rows: DataFrame, uid: str = "uid") -> DataFrame:
    """Ids in ascending order, duplicates kept.

    Copies are counted, the counts are sorted over range partitions in small blocks, and
    the blocks unfold in place. So an id with a third of all rows is many blocks that
    fall into many partitions, and not one partition of its own.
    """
    counts = subset_counts(rows.select(canonical_uid(F.col(uid)).alias("uid")))
    blocks = copy_blocks(counts, SORT_BLOCK).orderBy("uid", "_low")
    return unfold_copies(blocks).select("uid")


def subset_counts(subset: DataFrame) -> DataFrame:
    """``uid, copies``; an id that fills a third of the subset is combined before the shuffle."""
    return subset.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"))


def copy_blocks(counts: DataFrame, size: int = COPY_BLOCK) -> DataFrame:
    """Rows with ``copies`` cut into rows of at most ``size`` copies each (``_low`` to ``_high``)."""
    last = F.floor((F.col("copies") - 1) / F.lit(size))
    low = F.col("_block") * size
    return (
        counts.filter("copies > 0")
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("_low", low)
        .withColumn("_high", F.least(F.col("copies"), low + size) - 1)
        .drop("_block")
    )


def unfold_copies(blocks: DataFrame) -> DataFrame:
    """One row per copy, numbered in ``copy``."""
    return blocks.withColumn("copy", F.explode(F.sequence("_low", "_high"))).drop(
        "copies", "_low", "_high"
    )


def expand_subset(pool: DataFrame, subset: DataFrame, hot_copies: int = HOT_COPIES) -> DataFrame:
    """Every pool sample once per occurrence of its id, with ``copy`` 0.. and ``sample_key``.

    Occurrences travel as counts, cut into blocks, so no row ever unfolds into more than
    ``COPY_BLOCK`` rows at once. An id with more than ``hot_copies`` copies is salted: its
    blocks go to as many tasks as it has multiples of that number, and its pool rows are
    repeated once per salt. There can be no more such ids than the subset has rows
    divided by ``hot_copies``, which bounds the broadcast. Pool rows that share an id
    are expanded each.
    """
    counts = subset_counts(subset)
    salts = F.least(F.ceil(F.col("copies") / F.lit(hot_copies)), F.lit(MOST_SALTS)).cast("bigint")
    hot = counts.filter(F.col("copies") > hot_copies).select("uid", salts.alias("_salts"))
    block = F.floor(F.col("_low") / F.lit(COPY_BLOCK))
    blocks = copy_blocks(counts).withColumn("_salt", F.pmod(block, salts))
    last_salt = F.coalesce(F.col("_salts"), F.lit(1).cast("bigint")) - 1
    salted = (
        pool.join(F.broadcast(hot), "uid", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last_salt)))
        .drop("_salts")
    )
    joined = salted.join(blocks, ["uid", "_salt"]).drop("_salt")
    return unfold_copies(joined).withColumn("sample_key", sample_key(F.col("uid"), F.col("copy")))


def intersect_subsets(left: DataFrame, right: DataFrame, multiset: bool = False) -> DataFrame:
    """Ids in both; with ``multiset`` each as often as in the side that has fewer."""
    if not multiset:
        return left.select("uid").intersect(right.select("uid"))
    both = subset_counts(left).join(
        subset_counts(right).withColumnRenamed("copies", "_other"), "uid"
    )
    counts = both.select("uid", F.least("copies", "_other").alias("copies"))
    return _unfold(counts)


def subtract_subset(left: DataFrame, right: DataFrame, multiset: bool = False) -> DataFrame:
    """Ids of ``left`` not in ``right``; with ``multiset`` occurrences are subtracted."""
    if not multiset:
        return left.select("uid").join(right.select("uid").distinct(), "uid", "left_anti")
    counts = (
        subset_counts(left)
        .join(subset_counts(right).withColumnRenamed("copies", "_other"), "uid", "left")
        .select("uid", (F.col("copies") - F.coalesce("_other", F.lit(0))).alias("copies"))
        .filter("copies > 0")
    )
    return _unfold(counts)


def _unfold(counts: DataFrame) -> DataFrame:
    return unfold_copies(spread(copy_blocks(counts), "uid", "_low")).select("uid")


def unite_subsets(*subsets: DataFrame, distinct: bool = True) -> DataFrame:
    """All ids of several subsets, once each or as a bag."""
    first, *rest = [s.select("uid") for s in subsets]
    for other in rest:
        first = first.unionByName(other)
    return first.distinct() if distinct else first


def subset_unmatched(subset: DataFrame, pool: DataFrame) -> DataFrame:
    """Ids of the subset that no pool sample has, with how often they were asked for."""
    return subset_counts(subset).join(pool.select("uid").distinct(), "uid", "left_anti")


def subset_audit(pool: DataFrame, subset: DataFrame) -> DataFrame:
    """One row: samples read, samples asked for, samples emitted, ids asked for in vain.

    Counted per id on both sides before they meet, so a hot id is one row in the join.
    """
    asked = subset_counts(subset)
    present = pool.groupBy("uid").agg(F.count(F.lit(1)).alias("_present"))
    return present.join(asked, "uid", "full").agg(
        F.coalesce(F.sum("_present"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("requested"),
        F.coalesce(F.sum(F.col("_present") * F.col("copies")), F.lit(0)).alias("output"),
        F.count_if(F.col("_present").isNull()).alias("unmatched_ids"),
    )
