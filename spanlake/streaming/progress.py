"""Progress events: percentages, latest state per project, and event-time windows, as streams or tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.storage import shared_folder


def percent(stage: Column, sub: Column, weights: Mapping[str, int], done: str | None = None) -> Column:
    """Share done: weights of earlier stages plus the part ``sub`` (percent) of this one, at most 99; without a part (null)
    the earlier stages alone, and for the stage ``done`` all with it."""
    out, before = F.lit(None).cast("double"), 0
    for name, weight in weights.items():
        whole = F.lit(float(min(100, before + weight))) if name == done else F.lit(float(min(99, before)))
        out = F.when(stage == name, F.when(sub.isNull(), whole).otherwise(F.least(F.lit(99.0), before + weight * sub / 100.0))).otherwise(out)
        before += weight
    return F.floor(out)


def latest(events: DataFrame, key: str, by: Sequence[str], *columns: str) -> DataFrame:
    """Latest values per key; the same expression serves a table and a stream in update mode."""
    best = events.groupBy(key).agg(F.max(F.struct(*by, *columns)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in (*by, *columns)])


def windowed(events: DataFrame, ts: str, width: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; on a stream, rows later than ``late`` behind the watermark are left out."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    counted = events.groupBy(F.window(ts, width).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("_w.start").alias("start"), *keys, "n")


def expired(stream: DataFrame, key: str, ident: str, ts: str, ttl: int, late: str = "10 minutes") -> DataFrame:
    """``key``, ``ident`` of values that reach their time to live of ``ttl`` microseconds before another of their key comes.

    State holds the one valid value of a key. It is given out when a later value comes after its time, or by a timer of
    event time once the watermark has passed that; late rows are left out. A key's rows of one micro-batch are sorted in
    memory: ``maxFilesPerTrigger`` bounds them.
    """
    kinds = dict(stream.dtypes)

    def update(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append(state.get[0])
            state.remove()
        else:
            held = state.get if state.exists else None
            for row in pd.concat(frames).rename(columns={"_us": "us_"}).sort_values(["us_", ident]).itertuples(index=False):
                value, us = getattr(row, ident), row.us_
                if held is not None and us > held[1] + ttl:
                    out.append(held[0])
                if held is None or (us, value) >= (held[1], held[0]):
                    held = (int(value), int(us))
            state.update(held)
            state.setTimeoutTimestamp(max((held[1] + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]] * len(out), ident: out})

    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.select(key, ident, ts, F.unix_micros(ts).alias("_us"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kinds[key]}, {ident} {kinds[ident]}", f"{ident} long, us long", "append", "EventTimeTimeout")


def reader(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of ``files`` a micro-batch."""
    table = spark.read.parquet(path)
    parent, name = path.rsplit("/", 1)
    reader = spark.readStream.schema(table.schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if any(f.rsplit("/", 1)[1] == name for f in table.inputFiles()):  # a single file is streamed by way of its folder
        reader, path = reader.option("pathGlobFilter", name), parent
    return reader.parquet(path)


def drained(spark: SparkSession, path: str, through: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "append", files: int | None = None) -> DataFrame:
    """A Parquet table read as a stream to its end, passed ``through`` a transformation, written and read back.

    Output and state lie in the shared folder of ``spark.checkpoint.dir``.
    """
    folder = shared_folder(spark, "stream")
    stream = through(reader(spark, path, files))
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def streamed_latest(spark: SparkSession, path: str, key: str, by: Sequence[str], *columns: str, files: int | None = None) -> DataFrame:
    """``latest`` kept by a stream in update mode: each micro-batch writes the keys that it changed, readers take the newest."""
    folder = shared_folder(spark, "latest")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream = latest(reader(spark, path, files), key, by, *columns)
    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(f"{folder}/out"), key, by, *columns)


def upserted(spark: SparkSession, path: str, key: str, by: Sequence[str], *columns: str, files: int = 1) -> DataFrame:
    """Latest values per key of a table read as a stream; each micro-batch is merged into a new version of the snapshot.

    A version is written beside the last one and only then named, so a batch that is tried again does no harm.
    """
    folder = shared_folder(spark, "upsert")
    last: list[str] = []

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(key, *by, *columns)
        if last:
            rows = rows.unionByName(batch.sparkSession.read.parquet(last[-1]))
        latest(rows, key, by, *columns).select(key, *by, *columns).write.mode("overwrite").parquet(f"{folder}/v{number}")
        last.append(f"{folder}/v{number}")

    reader(spark, path, files).writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(last[-1]) if last else latest(spark.read.parquet(path), key, by, *columns)
