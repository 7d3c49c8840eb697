"""Histograms and counts that describe a pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.functions.text import first_words_count

# The bin borders of the published profile.
LENGTH_BORDERS = (0, 3, 5, 7, 10, 15, 20)
SCORE_BORDERS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def _binned(df: DataFrame, inside: Sequence[Column], labels: Sequence[str]) -> DataFrame:
    """``bin_id, bin, n, share`` with empty bins kept; ``share`` is of all binned rows.

    One aggregate counts every bin, so a single row per task is shuffled.
    """
    counts = df.agg(*[F.count_if(test).alias(f"_{i}") for i, test in enumerate(inside)])
    total = sum((F.col(f"_{i}") for i in range(len(labels))), F.lit(0)).cast("double")
    bins = [
        F.struct(
            F.lit(i).alias("bin_id"),
            F.lit(label).alias("bin"),
            F.col(f"_{i}").alias("n"),
            F.try_divide(F.col(f"_{i}").cast("double"), total).alias("share"),
        )
        for i, label in enumerate(labels)
    ]
    return counts.select(F.inline(F.array(*bins)))


def length_hist(df: DataFrame, text: str = "text") -> DataFrame:
    """Captions per word-count bin ``[a, b)``; the last bin starts at 20, NULL has no words.

    Words are counted up to the last border only, so long texts are not split whole.
    """
    borders = LENGTH_BORDERS
    place = F.col("_words")
    inside = [(place >= a) & (place < b) for a, b in zip(borders, borders[1:])] + [place >= borders[-1]]
    labels = [f"[{a}, {b})" for a, b in zip(borders, borders[1:])] + [f">{borders[-1]}"]
    count = first_words_count(F.coalesce(F.col(text), F.lit("")), borders[-1])
    return _binned(df.select(count.alias("_words")), inside, labels)


def score_bin(score: Column) -> Column:
    """Index of the tenth ``(a, b]`` that holds the score; NULL outside (0, 1], for NaN and NULL.

    Compared with the border literals, because scaling by ten would round some borders.
    """
    value = score.cast("double")
    bin_id = F.lit(None).cast("int")
    for i in range(len(SCORE_BORDERS) - 2, -1, -1):
        inside = (value > SCORE_BORDERS[i]) & (value <= SCORE_BORDERS[i + 1])
        bin_id = F.when(inside, F.lit(i)).otherwise(bin_id)
    return bin_id


def score_hist(df: DataFrame, score: str) -> DataFrame:
    """Rows per score tenth."""
    labels = [f"({a:.1f}, {b:.1f}]" for a, b in zip(SCORE_BORDERS, SCORE_BORDERS[1:])]
    binned = df.select(score_bin(F.col(score)).alias("_bin"))
    return _binned(binned, [F.col("_bin") == i for i in range(len(labels))], labels)


def rows_per_source(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source or file."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
