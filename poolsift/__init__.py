"""Curation and scoring of image-text training pools, written for PySpark.

Layout
------
``functions``  column expressions (ids, text, vectors, prompts, image sides)
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers and writers (pool parquet, subset files, tar shards, ...)
``plans``      end-to-end jobs composed from the above
``streaming``  incremental versions of the per-row filters
"""

__version__ = "0.1.0"
