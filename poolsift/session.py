"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this package is happy with, on a laptop or a cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "poolsift", master: str | None = None, **conf: object) -> SparkSession:
    """A session with :data:`SETTINGS`; keyword arguments use ``_`` for ``.``-free keys."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    ship_package()
    return spark


def ship_package() -> None:
    """Pickle this package's functions by value, so executors need no installation.

    A cluster that gets the package through ``--py-files`` or an image does not
    need this; calling it there does no harm.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset (a
    local test session) a temporary folder is made and used instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="poolsift-")
    spark.sparkContext.setCheckpointDir("file://" + folder)
    return "file://" + folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable, with the folder of :func:`shared_dir`."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one run of a job."""
    return os.path.join(shared_dir(spark), "runs", f"{name}-{uuid.uuid4().hex[:12]}")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: the lineage is cut, and what was finished is not lost."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
