"""Matching image files with caption rows, merging new captions, and resuming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.functions.text import parent_dir, path_stem


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row per key in ``order``.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a
    key with a third of all rows costs no more than another. ``order`` should not tie.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{c}") for c in rest])


def match_captions(
    images: DataFrame, captions: DataFrame, sidecars: DataFrame | None = None
) -> DataFrame:
    """Image files with the caption row of the same stem, and the text file next to them.

    ``images`` has ``path``; ``captions`` has ``filename, caption, uid, seq`` (the highest
    ``seq`` of a stem wins); ``sidecars`` has ``path, alt_text``. Every image is kept:
    ``status`` tells ``matched`` from ``no_caption_match``.
    """
    named = captions.filter(F.length("filename") > 0).withColumn("stem", path_stem(F.col("filename")))
    chosen = last_wins(named, ["stem"], ["seq", "filename"]).select("stem", "caption", "uid")
    placed = images.select(
        "path", path_stem(F.col("path")).alias("stem"), parent_dir(F.col("path")).alias("_dir")
    )
    matched = placed.join(chosen.withColumn("_hit", F.lit(True)), "stem", "left")
    if sidecars is None:
        alt = matched.withColumn("alt_text", F.lit(""))
    else:
        texts = sidecars.groupBy(
            parent_dir(F.col("path")).alias("_dir"), path_stem(F.col("path")).alias("stem")
        ).agg(F.max("alt_text").alias("_alt"))
        alt = matched.join(texts, ["_dir", "stem"], "left").withColumn(
            "alt_text", F.coalesce(F.trim("_alt"), F.lit(""))
        )
    status = F.when(F.col("_hit"), F.lit("matched")).otherwise(F.lit("no_caption_match"))
    return alt.select("path", "stem", "alt_text", "caption", "uid", status.alias("status"))


def merge_captions(captions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Caption table with ``new_caption`` joined on the file name; rows without one stay NULL.

    ``fresh`` has ``filename, new_caption, seq``; a file captioned twice keeps the latest.
    """
    latest = last_wins(fresh.select("filename", "new_caption", "seq"), ["filename"], ["seq", "new_caption"])
    return captions.join(latest.select("filename", "new_caption"), "filename", "left")


def remaining_work(work: DataFrame, done: DataFrame, key: str, result: str | None = None) -> DataFrame:
    """Work rows whose key is not done yet; with ``result`` only rows that have one count as done."""
    finished = done if result is None else done.filter(F.col(result).isNotNull())
    return work.join(finished.select(key).distinct(), key, "left_anti")


STATUSES = ("succeeded", "failed", "missing_image", "invalid_image", "no_caption_match")


def processing_stats(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """One row: total, a counter per status, and the success rate (0 without rows)."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in STATUSES]
    rate = F.coalesce(
        F.try_divide(F.col("succeeded").cast("double"), F.col("total").cast("double")), F.lit(0.0)
    )
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *counts).withColumn("success_rate", rate)


def failed_items(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """The rows for the error side file."""
    return outcomes.filter(F.col(status) == "failed")
