"""Queries over two streams and over the state of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.plans.catalogue import register
from spanlake.plans.more_queries import folder
from spanlake.plans.relational_queries import table
from spanlake.streaming import subscriptions
from spanlake.streaming.progress import reader

# a customer follows the user of its own number and the one before, ten days a third of them, and a sixth again after ten more
ACTIONS = """
WITH a AS (SELECT c_custkey, c_custkey - k AS topic, TIMESTAMP '2024-01-01' + to_days((c_custkey % 10)::INT + d) AS since, on_ FROM customer, range(0, 2) t(k), (VALUES (0, true), (10, false), (20, true)) v(d, on_)
  WHERE d = 0 OR d = 10 AND c_custkey % 3 = 0 OR d = 20 AND c_custkey % 6 = 0)"""


@register("S5_streamed_fan_out", ACTIONS + """
SELECT event_id, c_custkey AS subscriber FROM (SELECT event_id, c_custkey, arg_max(on_, since) AS on_ FROM events JOIN a ON a.topic = user_id AND a.since <= ts GROUP BY event_id, c_custkey) WHERE on_""")
def streamed_fan_out(spark, sf_dir):
    """Events and (un)subscriptions as two streams joined; a last row of each, much later, brings the watermarks past all."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array("c_custkey", F.col("c_custkey") - 1)).alias("topic"), F.explode(F.array(F.lit(0), F.lit(10), F.lit(20))).alias("d"))
    c = c.where("d = 0 or d = 10 and c_custkey % 3 = 0 or d = 20 and c_custkey % 6 = 0").join(table(spark, sf_dir, "events").select(F.col("user_id").alias("topic")).distinct(), "topic", "left_semi")
    at = F.timestamp_add("DAY", (F.col("c_custkey") % 10 + F.col("d")).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    actions = c.select("topic", F.col("c_custkey").alias("subscriber"), at.alias("at"), (F.col("d") != 10).alias("active"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("topic"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    places = folder(spark), folder(spark)
    for out, rows, end in ((places[0], events, "-1L as topic, -1L as event_id, timestamp'2030-01-01' as ts"), (places[1], actions, "-2L as topic, -1L as subscriber, timestamp'2030-01-01' as at, true as active")):
        rows.write.parquet(out)
        spark.range(1).selectExpr(*end.split(", ")).write.mode("append").parquet(out)
    return subscriptions.delivered_to_end(spark, *places, horizon="60 days").select("event_id", "subscriber")


@register("S4_progress_cache", "SELECT user_id AS key, event_type AS stage, epoch_us(max(ts)) AS ts, arg_max(value, (ts, value)) AS percent FROM events GROUP BY user_id, event_type")
def progress_cache(spark, sf_dir):
    """The last percentage of each stage of a project, from a stream's keyed state."""
    rows = reader(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_type").alias("stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("percent"))
    return subscriptions.cache_of(spark, rows)
