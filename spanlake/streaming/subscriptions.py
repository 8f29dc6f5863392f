"""Events sent to the subscribers of their topic, as a join of two streams, and a progress cache kept in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanlake.storage import shared_folder
from spanlake.streaming.progress import reader


def delivered(events: DataFrame, actions: DataFrame, horizon: str, late: str = "10 minutes") -> DataFrame:
    """``event_id, ts, subscriber`` for everybody whose last action on an event's topic, at most ``horizon`` before it, is to subscribe.

    ``events`` have ``topic``, ``event_id``, ``ts``; ``actions`` have ``topic``, ``subscriber``, ``at``, ``active`` (false: to
    unsubscribe); of two at one time the one to unsubscribe counts. Both may be tables, or both streams: rows later than
    ``late`` are then left out, state is kept for ``horizon``, and an event is given out once the watermarks of both have passed it by as much.
    """
    if events.isStreaming:
        events, actions = events.withWatermark("ts", late), actions.withWatermark("at", late)
    e, a = events.alias("e"), actions.alias("a")
    met = e.join(a, F.expr(f"e.topic = a.topic AND a.at <= e.ts AND a.at >= e.ts - INTERVAL {horizon}"))
    last = met.groupBy("e.ts", "e.event_id", "a.subscriber").agg(F.max_by("a.active", F.struct("a.at", (~F.col("a.active")).alias("off"))).alias("active"))
    return last.where("active").select("event_id", "ts", "subscriber")


class _Cache(StatefulProcessor):
    """A map from stage to its last percentage for each key; entries go after their time to live."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stages = handle.getMapState("stages", "stage string", "ts bigint, percent double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        changed = {}
        for frame in rows:
            for stage, ts, percent in zip(frame["stage"], frame["us"], frame["percent"], strict=True):
                held = changed.get(stage) or (self.stages.getValue((stage,)) if self.stages.containsKey((stage,)) else None)
                if held is None or (ts, percent) >= tuple(held):
                    changed[stage] = (int(ts), float(percent))
        for stage, value in changed.items():
            self.stages.updateValue((stage,), value)
        yield pd.DataFrame({"key": [key[0]] * len(changed), "stage": list(changed), "ts": [v[0] for v in changed.values()], "percent": [v[1] for v in changed.values()]})

    def close(self) -> None:
        pass


def cached(stream: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """``key, stage, ts, percent`` (``us``: microseconds) of what a micro-batch has changed in a cache of the last percentage of each stage of a key.

    The cache is keyed state with a time to live after the last change, which ``spark.read.format("statestore")`` can read: state variable
    ``stages``. Needs the RocksDB state store.
    """
    rows = stream.select("key", "stage", "us", "percent").groupBy("key")
    return rows.transformWithStateInPandas(_Cache(ttl_ms), "key long, stage string, ts long, percent double", "Update", "ProcessingTime")


def cache_of(spark: SparkSession, stream: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """``key, stage, ts, percent`` that ``cached`` holds when a stream has been read to its end, taken from its state."""
    folder = shared_folder(spark, "cache")
    # time to live needs processing time, which would go on with empty micro-batches for ever
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        cached(stream, ttl_ms).writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").option("path", folder).option("stateVarName", "stages").load()
    return state.select("key.key", "user_map_key.stage", "user_map_value.value.ts", "user_map_value.value.percent")


def delivered_to_end(spark: SparkSession, events: str, actions: str, horizon: str, files: int | None = None) -> DataFrame:
    """``delivered`` of two Parquet folders read as streams to their end; what the watermarks have not passed is not given out."""
    folder = shared_folder(spark, "delivered")
    stream = delivered(reader(spark, events, files), reader(spark, actions, files), horizon)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
