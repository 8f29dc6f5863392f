"""Stages whose outputs are kept: a stage that succeeded is read, one that failed may be tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_STATE = "status string, retries int, message string"


def state(spark: SparkSession, folder: str) -> tuple[str, int]:
    """Status (``new``, ``success`` or ``failed``) and number of failures of the stage in ``folder``."""
    try:
        rows = spark.read.schema(_STATE).json(f"{folder}/state").collect()  # a row for each attempt
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return "new", 0
    return ("success" if any(r.status == "success" for r in rows) else "failed"), sum(r.status == "failed" for r in rows)


def should_retry(spark: SparkSession, folder: str, most: int = 3) -> bool:
    status, failures = state(spark, folder)
    return status != "success" and failures < most


def run(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The output of the stage: read if it succeeded before, else built, written and noted; a failure is noted and raised."""

    def note(status: str, message: str) -> None:
        spark.createDataFrame([(status, int(status == "failed"), message)], _STATE).write.mode("append").json(f"{folder}/state")

    if state(spark, folder)[0] != "success":
        try:
            build().write.mode("overwrite").parquet(f"{folder}/output")
        except Exception as e:
            note("failed", str(e)[:200])
            raise
        note("success", "")
    return spark.read.parquet(f"{folder}/output")
