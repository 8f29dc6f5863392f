"""Locating and listing files through Spark, whatever store they lie in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_existing(spark: SparkSession, paths: Sequence[str], kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """The table at the first of ``paths`` that exists; raises if none does."""
    for path in paths:
        try:
            reader = spark.read.format(kind) if schema is None else spark.read.format(kind).schema(schema)
            return reader.load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(", ".join(paths))


def listing(spark: SparkSession, folder: str, pattern: str = "*", before: str | None = None, after: str | None = None) -> DataFrame:
    """``name``, ``path``, ``length`` and ``modified`` of all files below ``folder``; contents are not read.

    ``before`` and ``after`` (``2024-01-31T12:00:00``, in the session's time zone) leave out files by their last change while
    they are listed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    for name, limit in (("modifiedBefore", before), ("modifiedAfter", after)):
        reader = reader if limit is None else reader.option(name, limit)
    files = reader.load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.col("modificationTime").alias("modified"))
