"""Queries over files of subtitles and JSON arrays: tables are written as such files and read back by byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.times import format_ms
from spanlake.plans.catalogue import register
from spanlake.plans.more_queries import ONE_LINE, folder, one_line
from spanlake.plans.relational_queries import table
from spanlake.sources import json_arrays, subtitles
from spanlake.sources.versions import Versions, corrected_once

#: Bytes of a range: small, so that files of the given tables are cut into many.
RANGE = 1 << 15

# a block of each turn: some without a number, some with stamps that aren't any, some with full stops in them
BLOCKS = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, {ONE_LINE} AS one, conv_id * 1000 + turn * 10 AS a, conv_id * 1000 + turn * 10 + length(text) AS b FROM conversations WHERE length({ONE_LINE}) > 0),
f AS (SELECT *, CASE WHEN turn % 7 <> 0 THEN turn::INT END AS seq, turn % 5 = 0 AS bad, turn % 3 = 1 AS stops,
  printf('%02d:%02d:%02d', a // 3600000, a // 60000 % 60, a // 1000 % 60) AS ta, printf('%02d:%02d:%02d', b // 3600000, b // 60000 % 60, b // 1000 % 60) AS tb FROM t),
g AS (SELECT *, CASE WHEN bad THEN 'a' || turn ELSE ta || CASE WHEN stops THEN '.' ELSE ',' END || printf('%03d', a % 1000) END AS start, CASE WHEN bad THEN 'b' || turn ELSE tb || CASE WHEN stops THEN '.' ELSE ',' END || printf('%03d', b % 1000) END AS "end" FROM f)"""


def subtitle_files(spark, sf_dir):
    """A folder of subtitle files with a block for each turn, four speakers' worth of conversations in each subfolder."""
    out = folder(spark)
    one = one_line("text")
    t = table(spark, sf_dir, "conversations").where(F.length(one) > 0).withColumn("a", F.col("conv_id") * 1000 + F.col("turn") * 10)
    t = t.withColumn("b", F.col("a") + F.length("text"))
    stamp = lambda c: F.when(F.col("turn") % 3 == 1, F.replace(format_ms(F.col(c)), F.lit(","), F.lit("."))).otherwise(format_ms(F.col(c)))
    turn = F.col("turn").cast("string")
    bad = F.col("turn") % 5 == 0
    number = F.when(F.col("turn") % 7 == 0, F.concat(F.lit("n"), turn)).otherwise(turn)
    line = F.concat(F.when(bad, F.concat(F.lit("a"), turn)).otherwise(stamp("a")), F.lit(" --> "), F.when(bad, F.concat(F.lit("b"), turn)).otherwise(stamp("b")))
    block = F.concat_ws("\n", number, line, one, F.coalesce("role", F.lit("")))
    t.select((F.col("conv_id") % 4).alias("part"), block.alias("value")).write.partitionBy("part").option("lineSep", "\n\n").text(out)
    return out


def read_subtitles(spark, sf_dir, grammar):
    subtitles.register(spark)
    return spark.read.format("subtitles").option("path", subtitle_files(spark, sf_dir)).option("grammar", grammar).option("range_bytes", RANGE).load()


@register("A4_validated_blocks", BLOCKS + " SELECT a AS start_ms, b AS end_ms, trim(one || ' ' || role, ' ') AS text FROM g WHERE NOT bad")
def validated_blocks(spark, sf_dir):
    return read_subtitles(spark, sf_dir, "timeline").select("start_ms", "end_ms", "text")


@register("A5_plain_blocks", BLOCKS + ' SELECT start, "end", one || \' \' || role AS content FROM g')
def plain_blocks(spark, sf_dir):
    """Blocks whose stamps are taken as they stand."""
    return read_subtitles(spark, sf_dir, "plain").select("start", "end", F.col("text").alias("content"))


@register("A6_starts", BLOCKS + " SELECT seq AS index, start, one || chr(10) || role AS text FROM g WHERE seq IS NOT NULL")
def starts(spark, sf_dir):
    """Numbered blocks with their start alone, lines kept apart."""
    return read_subtitles(spark, sf_dir, "starts").select(F.col("seq_num").alias("index"), "start", "text")


@register("A7_stamps", BLOCKS + " SELECT a / 1000 AS start_seconds, b / 1000 AS end_seconds FROM g WHERE NOT bad AND NOT stops")
def stamps(spark, sf_dir):
    """Pairs of stamps with commas, wherever they stand."""
    return read_subtitles(spark, sf_dir, "stamps").select((F.col("start_ms") / 1000).alias("start_seconds"), (F.col("end_ms") / 1000).alias("end_seconds"))


@register("A8_json_arrays", "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, ['[' || o_orderpriority || '}', '\"'] AS tags FROM orders")
def json_arrays_read(spark, sf_dir):
    """Files that are one array each, plain or under one or two keys of a wrapper, read by byte ranges."""
    out = folder(spark)
    o = table(spark, sf_dir, "orders")
    one = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.array(F.concat(F.lit("["), "o_orderpriority", F.lit("}")), F.lit('"')).alias("tags")))
    form = F.col("o_orderkey") % 3
    head = {0: "[", 1: '{"note": "[{", "clips": [', 2: '{"old": {"clips": [{"id": -1}]}, "data": {"n": 1, "clips": ['}
    tail = {0: "]", 1: '], "total": {"id": -2}}', 2: "]}}"}
    # a file for each form and hundredth of the keys: what one step file holds
    rows = o.groupBy(form.alias("form"), (F.col("o_orderkey") % 100).alias("lot")).agg(F.array_join(F.collect_list(one), ",\n").alias("body"))
    pick = lambda m: F.get(F.array(*[F.lit(m[k]) for k in range(3)]), F.col("form").cast("int"))
    rows.select(F.concat(pick(head), "body", pick(tail)).alias("value"), "form", "lot").write.partitionBy("form", "lot").text(out)
    found = json_arrays.read(spark, out, "id long, status string, price double, tags array<string>", ((), ("clips",), ("data", "clips")), pattern="*.txt", width=RANGE)
    return found.select("id", "status", "price", "tags")


@register("B8_stored_changes", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT s_suppkey + 100000000, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0""")
def stored_changes(spark, sf_dir):
    """Rows created, updated and deleted in a stored table, compacted in between."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    stored = Versions(spark, folder(spark), ["c_custkey"])
    stored.create(c)
    stored.update(c.where("c_custkey % 5 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")))
    stored.create(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")))
    stored.compact()
    stored.delete(c.where("c_custkey % 7 = 0"))
    stored.delete(table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select((F.col("s_suppkey") + 100_000_000).alias("c_custkey")))
    return stored.read()


@register("B2_stored_correction", "SELECT conv_id, turn, text AS first, replace(text, 'the', 'THE') AS text FROM conversations")
def stored_correction(spark, sf_dir):
    """Texts corrected where they are stored, once (a second run changes nothing), and as they were first."""
    stored = Versions(spark, folder(spark), ["conv_id", "turn"])
    stored.create(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    for _ in range(2):
        corrected_once(stored, "text", lambda t: F.replace(t, F.lit("the"), F.lit("THE")))
    return stored.first().withColumnRenamed("text", "first").join(stored.read(), ["conv_id", "turn"])
