"""Vector expressions over ``array<float>`` columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    squares = F.transform(v, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def l2_normalize(v: Column, length: Column | None = None) -> Column:
    """``v`` scaled to length one; a zero vector is returned as it is.

    Pass ``length`` when it is already a column, so it is not worked out per element.
    """
    size = norm(v) if length is None else length
    scale = F.when(size > 0, size).otherwise(F.lit(1.0))
    return F.transform(v, lambda x: x.cast("double") / scale)


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest element, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def rank_of(scores: Column, index: Column) -> Column:
    """One-based rank of element ``index`` in descending order, ties in index order."""
    own = F.get(scores, index)
    ahead = F.filter(
        F.transform(scores, lambda x, i: (x > own) | ((x == own) & (i < index))), lambda hit: hit
    )
    return F.when(own.isNotNull(), F.size(ahead) + 1)
