"""Image size predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _both(width: Column, height: Column) -> Column:
    # least/greatest skip NULL in SQL; a missing side must make the result missing.
    return width.isNotNull() & height.isNotNull()


def min_side(width: Column, height: Column) -> Column:
    return F.when(_both(width, height), F.least(width, height))


def max_side(width: Column, height: Column) -> Column:
    return F.when(_both(width, height), F.greatest(width, height))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Long side over short side; NULL for a missing or zero side."""
    return F.try_divide(
        max_side(width, height).cast("double"), min_side(width, height).cast("double")
    )


def size_ok(width: Column, height: Column, least_side: int, most_aspect: float) -> Column:
    """Short side long enough and not too elongated.

    The side test is one comparison per column, which parquet can check by its statistics. The
    aspect is multiplied out, so a zero side divides nothing.
    """
    short = F.least(width, height).cast("double")
    long = F.greatest(width, height).cast("double")
    return (
        (width >= least_side) & (height >= least_side) & (long <= short * F.lit(float(most_aspect)))
    )
