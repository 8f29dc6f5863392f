"""The shared folder for tables and state that outlive a task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves a local master, whose tasks share it; on a cluster each executor would
    write to its own disk, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Sets the context's checkpoint folder unless it has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoints"))
