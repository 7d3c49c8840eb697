"""Images with caption rows to refined captions: match, resume, caption, merge, report."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.functions.text import base_name
from poolsift.operators.captions import match_captions, merge_captions, processing_stats, remaining_work
from poolsift.session import saved
from poolsift.sources.images import image_listing, read_sidecars
from poolsift.sources.storage import entries
from poolsift.sources.tables import write_failed


def caption_rows(spark: SparkSession, path: str) -> DataFrame:
    """Caption rows with ``seq``, their place in the files, so that the last one of a file name wins."""
    rows = spark.read.parquet(path)
    return rows.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("seq"))


def refine_captions(
    spark: SparkSession, image_dir: str, captions_path: str, output: str, caption: Callable[[DataFrame], DataFrame], resume: bool = False
) -> DataFrame:
    """One row of counters; writes ``new`` (captions as they come), ``failed`` and ``captions`` (the merged table) under ``output``.

    ``caption`` takes the images to work on (``filename, path, alt_text, caption, uid``) and returns ``filename, new_caption``,
    NULL where it failed; it may be any Arrow or pandas function. With ``resume`` files that have a new caption already
    are left out, whether they were written by a run that ended or not; what a run adds lies in files of its own.
    """
    captions = caption_rows(spark, captions_path)
    images = image_listing(spark, image_dir)
    matched = match_captions(images.where("status = 'ok'").select("path"), captions, read_sidecars(spark, image_dir))
    matched = saved(matched.withColumn("filename", base_name(F.col("path"))), "matched-images")
    work = matched.where("status = 'matched'").drop("status", "stem")
    folder = posixpath.join(output, "new")
    earlier = spark.read.parquet(folder) if resume and entries(folder) else None
    todo = work if earlier is None else remaining_work(work, earlier, "filename", "new_caption")
    run = 0 if earlier is None else earlier.agg(F.max("run")).first()[0] + 1
    done = caption(todo).select("filename", "new_caption").withColumn("run", F.lit(run))
    done.write.mode("append" if resume else "overwrite").parquet(folder)

    everything = spark.read.parquet(folder)
    mine = everything.where(F.col("run") == run)
    outcomes = mine.select("filename", F.when(F.col("new_caption").isNull(), "failed").otherwise("succeeded").alias("status"))
    write_failed(outcomes, posixpath.join(output, "failed"))
    fresh = everything.where("new_caption IS NOT NULL").select("filename", "new_caption", F.col("run").alias("seq"))
    merged = merge_captions(captions.drop("seq"), fresh)
    merged.write.mode("overwrite").parquet(posixpath.join(output, "captions"))
    skipped = matched.where("status <> 'matched'").select("filename", "status")
    invalid = images.where("status <> 'ok'").select(base_name(F.col("path")).alias("filename"), F.lit("invalid_image").alias("status"))
    return processing_stats(outcomes.unionByName(skipped).unionByName(invalid))
