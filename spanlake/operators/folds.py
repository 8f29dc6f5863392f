"""Rules that read their own earlier decisions: one pass over sorted partitions with the state of one key at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, its session set to hand Python at most ``rows`` rows at a time: texts may be long, and workers keep what they once took."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``step`` of each key's rows (as dicts, sorted by ``order``); a key's rows are streamed, never gathered."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    columns = to_arrow_schema(_parse_datatype_string(schema))  # a column may be null in all of a batch's rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby, islice

        rows = (row for batch in batches for row in batch.to_pylist())
        made = (out for _, part in groupby(rows, key=lambda r: [r[k] for k in keys]) for out in step(part))
        while some := list(islice(made, 1000)):
            yield pa.RecordBatch.from_pylist(some, columns)

    return dealt.mapInArrow(run, schema)
