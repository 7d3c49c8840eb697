"""Exact order statistics of a score column, without sorting the pool."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Histogram buckets per pass. Every pass returns at most this many rows plus one.
BUCKETS = 1 << 16


def real_score(score: Column) -> Column:
    """Score as double with NaN turned into NULL, so that no comparison lets it through."""
    value = score.cast("double")
    return F.when(~F.isnan(value), value)


def _histogram(scores: DataFrame, low: float, high: float) -> DataFrame:
    """(bucket, n, lowest, highest), buckets in score order; NULL scores in a NULL bucket.

    The bucket of a score never decreases as the score grows, whatever the rounding,
    so buckets keep the score order and the two outermost ones take what lies outside.
    """
    unit = _unit(low, high)
    per_unit = BUCKETS / (high * unit - low * unit)
    place = F.floor((F.col("s") * F.lit(unit) - F.lit(low * unit)) * F.lit(per_unit))
    bucket = F.greatest(F.least(place, F.lit(BUCKETS - 1)), F.lit(0))
    return scores.groupBy(F.when(F.col("s").isNotNull(), bucket).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("lowest"), F.max("s").alias("highest")
    )


def _unit(low: float, high: float) -> float:
    """A power of two that keeps the width of the range away from overflow and underflow."""
    width = high - low
    if math.isinf(width):
        return 2.0**-4
    return 2.0**600 if width < 1e-200 else 1.0


def _bucket_at(histogram: DataFrame, fraction: float | None, rank: int | None):
    """The histogram row that holds the wanted descending rank, with the rows above it.

    The window has no partition key, which is fine for at most ``BUCKETS`` + 1 rows.
    """
    down = W.orderBy(F.col("bucket").desc_nulls_last())
    wanted = F.lit(rank) if rank is not None else F.floor(F.col("total") * F.lit(float(fraction)))
    return (
        histogram.withColumn("total", F.sum("n").over(W.partitionBy()))
        .withColumn("upto", F.sum("n").over(down.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("wanted", wanted)
        .filter((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("n") <= F.col("wanted")))
        .select("lowest", "highest", "n", "total", "wanted", (F.col("upto") - F.col("n")).alias("above"))
        .first()
    )


def score_at_rank(df: DataFrame, score: str, rank: int) -> float:
    """Value at 0-based ``rank`` of the descending sort; NaN when the rank lies among missing ones."""
    return _select(df, score, None, rank)


def score_threshold(df: DataFrame, score: str, fraction: float) -> float:
    """Score of the sample at descending rank ``int(N * fraction)`` (0-based).

    ``N`` counts every row. Missing and NaN scores rank last; when the rank falls
    among them the threshold is NaN. Raises ``ValueError`` where no such rank exists.

    The pool is never sorted or gathered. Pass one counts a histogram of the score
    column, the bucket with the wanted rank is found, and the next pass repeats
    this inside that bucket (a pushed-down range) until it holds one value. Each
    pass aggregates before its shuffle, so neither the size of the pool nor ties
    or clustering of its scores matter. Two passes are the usual number.
    """
    if not fraction >= 0 or fraction >= 1:
        raise ValueError("fraction must be in [0, 1)")
    return _select(df, score, fraction, None)


def _select(df: DataFrame, score: str, fraction: float | None, rank: int | None) -> float:
    scores = df.select(real_score(F.col(score)).alias("s"))
    low, high = -1.0, 1.0  # similarity scores; other ranges only cost one more pass
    found = _bucket_at(_histogram(scores, low, high), fraction, rank)
    if found is None:
        raise ValueError("the table is empty or has fewer rows than the wanted rank")
    left = found.wanted - found.above
    while True:
        if found.lowest is None:
            return math.nan
        if found.lowest == found.highest:
            return found.lowest
        low, high = found.lowest, found.highest
        inside = scores.filter((F.col("s") >= low) & (F.col("s") <= high))
        if math.isinf(low) or math.isinf(high):
            found = _infinities_apart(inside, left)
        else:
            found = _bucket_at(_histogram(inside, low, high), None, left)
        left -= found.above


def _infinities_apart(inside: DataFrame, rank: int):
    """At most three buckets: minus infinity, the finite scores, infinity."""
    sign = F.when(F.col("s") == math.inf, 1).when(F.col("s") == -math.inf, -1).otherwise(0)
    return _bucket_at(
        inside.groupBy(sign.alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("s").alias("lowest"), F.max("s").alias("highest")
        ),
        None,
        rank,
    )


def at_least(score: Column, threshold: float) -> Column:
    """``score >= threshold`` where NaN and NULL fail on either side."""
    if math.isnan(threshold):
        return F.lit(False)
    value = score.cast("double")
    return (value >= F.lit(float(threshold))) & ~F.isnan(value)
