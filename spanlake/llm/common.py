"""What the corpus operators share: table reading, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.storage import checkpoints


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; the path may lie in any store that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that a lost executor costs no recomputation."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def unused(name: str, taken: Sequence[str]) -> str:
    """``name``, lengthened until no name in ``taken`` equals it in any case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def keep_ids(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi", most: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``ids`` (one column of that name), or is not (``left_anti``).

    ``ids`` is broadcast only if a count shows that it has at most ``most`` rows (8 bytes each); beyond that the
    join shuffles both sides.
    """
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, key, how)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, which has few numbers a row and a cut lineage, marked for broadcast if a count shows at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def band(data: Column, index: int, width: int) -> Column:
    """Bucket key of the ``index``-th ``width`` bytes of a binary column."""
    return F.xxhash64(F.lit(index), F.substring(data, index * width + 1, width))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, its session set to hand Python at most ``rows`` rows at a time.

    Texts may be long: with the default of 10,000 rows a batch takes several times tens of megabytes in each task, and
    both the executor and its Python worker keep what they once took.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    return df


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batches`` whose strings in ``column`` have about ``size`` bytes together, or one row that has more.

    Python objects and work arrays then take a bounded multiple of that, however many or long a batch's texts are.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
