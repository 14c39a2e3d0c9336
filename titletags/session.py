"""A session for local use; on a cluster the operators take whatever session there is."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from functools import cache

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("titletags")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", True)
        .config("spark.sql.adaptive.skewJoin.enabled", True)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", True)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", False)
        .config("spark.checkpoint.dir", local_folder())
        .getOrCreate()
    )


@cache
def local_folder() -> str:
    """A folder of this process for intermediate tables, gone when the process ends."""
    path = tempfile.mkdtemp(prefix="titletags-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_base(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share.

    A cluster has to name it in `spark.checkpoint.dir` (or by `setCheckpointDir`). In
    local mode, where driver and executor are one process, a local folder will do.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is not None:
        return named
    if re.match(r"local(\[|$)", context.master):
        return local_folder()
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
