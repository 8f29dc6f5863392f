"""Two streams joined, and keyed state: several micro-batches, late rows, an unsubscription in between."""

import datetime as dt

from spanlake.streaming import subscriptions
from spanlake.streaming.progress import reader

DAY = dt.datetime(2024, 1, 1)
EVENTS, ACTIONS = "topic long, event_id long, ts timestamp", "topic long, subscriber long, at timestamp, active boolean"


def minutes(m):
    return DAY + dt.timedelta(minutes=m)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_deliveries(spark, tmp_path):
    e, a = str(tmp_path / "e"), str(tmp_path / "a")
    events = [[(1, 10, minutes(5)), (2, 11, minutes(6))], [(1, 12, minutes(30)), (1, 13, minutes(50))], [(1, 14, minutes(70)), (3, 15, minutes(71))]]
    actions = [[(1, 100, minutes(0), True), (1, 101, minutes(10), True)], [(1, 100, minutes(40), False), (2, 102, minutes(7), True)], [(1, 100, minutes(60), True), (1, 101, minutes(60), True), (1, 101, minutes(60), False)]]
    for x, y in zip(events, actions):
        put(spark, e, x, EVENTS)
        put(spark, a, y, ACTIONS)
    put(spark, e, [(-1, -1, minutes(100_000))], EVENTS)
    put(spark, a, [(-2, -2, minutes(100_000), True)], ACTIONS)
    put(spark, e, [(1, 99, minutes(20))], EVENTS)  # far too late
    put(spark, a, [(2, 103, minutes(1), True)], ACTIONS)
    got = sorted((r.event_id, r.subscriber) for r in subscriptions.delivered_to_end(spark, e, a, "10 days", files=1).collect())
    assert got == [(10, 100), (12, 100), (12, 101), (13, 101), (14, 100)]
    # the same expression over tables, where nothing is late
    table = subscriptions.delivered(spark.read.parquet(e), spark.read.parquet(a), "10 days").collect()
    assert sorted((r.event_id, r.subscriber) for r in table) == sorted([*got, (11, 103), (99, 100), (99, 101)])


def test_progress_cache(spark, tmp_path):
    path = str(tmp_path / "p")
    for rows in ([(1, "cut", 10, 5.0), (2, "cut", 1, 1.0)], [(1, "cut", 8, 99.0), (1, "join", 11, 2.0)], [(1, "cut", 12, 7.0), (1, "cut", 12, 8.0), (None, "cut", 1, 3.0)]):
        put(spark, path, rows, "key long, stage string, us long, percent double")
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    found = subscriptions.cache_of(spark, reader(spark, path, 1)).collect()
    assert sorted((r.key or 0, r.stage, r.ts, r.percent) for r in found) == [(0, "cut", 1, 3.0), (1, "cut", 12, 8.0), (1, "join", 11, 2.0), (2, "cut", 1, 1.0)]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before
