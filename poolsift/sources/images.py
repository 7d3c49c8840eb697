"""Image files and the text files next to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsift.functions.text import parent_dir, path_stem, path_suffix
from poolsift.sources.tables import list_files

# Accepted extensions and the largest accepted file.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
MAX_IMAGE_BYTES = 20 * 1024 * 1024


def image_listing(
    spark: SparkSession,
    folder: str,
    suffixes: Sequence[str] = IMAGE_SUFFIXES,
    max_bytes: int = MAX_IMAGE_BYTES,
    max_depth: int | None = None,
) -> DataFrame:
    """Image files under a folder with ``stem``, ``dir`` and ``status`` (ok or too_large).

    With ``max_depth`` files more than so many folders below it are left out.
    """
    files = list_files(spark, folder, recursive=True)
    if max_depth is None:
        return classify_images(files, suffixes, max_bytes)
    below = F.element_at(F.split("path", rf"\Q{folder.rstrip('/')}/\E", 2), -1)
    shallow = files.filter(F.size(F.split(below, "/")) - 1 <= max_depth)
    return classify_images(shallow, suffixes, max_bytes)


def classify_images(
    files: DataFrame, suffixes: Sequence[str] = IMAGE_SUFFIXES, max_bytes: int = MAX_IMAGE_BYTES
) -> DataFrame:
    """Rows of a file listing that are images, with their admission status."""
    path = F.col("path")
    return files.filter(path_suffix(path).isin(*suffixes)).select(
        "path",
        "length",
        parent_dir(path).alias("dir"),
        path_stem(path).alias("stem"),
        F.when(F.col("length") <= max_bytes, "ok").otherwise("too_large").alias("status"),
    )


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1; without blanks and line breaks at the ends."""
    # encode/decode of iso-8859-1 maps every byte, so the fallback cannot fail.
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """``path, alt_text`` of the ``.txt`` files under a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.txt")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", decode_text(F.col("content")).alias("alt_text"))
    )
