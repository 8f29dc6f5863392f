"""Queries over the small store: customers stand for projects, orders for clips and line items for tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlake.functions import text as tx
from spanlake.operators import relational as rel
from spanlake.plans.catalogue import register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLIPS = "WITH clips AS (SELECT o_orderkey AS clip_id, o_custkey AS project_id, o_orderstatus AS status, round(o_totalprice / 1000000, 4) AS score, o_orderdate AS created, o_orderpriority AS title FROM orders)"


def clips(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("clip_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("status"),
        F.round(F.col("o_totalprice") / 1_000_000, 4).alias("score"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("title"),
    )


@register("A12_table_scan", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def table_scan(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


@register("C1_find_by", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def find_by(spark, sf_dir):
    return table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 7)).select("c_custkey", "c_name")


@register("C2_get_by_project", CLIPS + " SELECT clip_id, status, score FROM clips WHERE project_id = 11")
def get_by_project(spark, sf_dir):
    return clips(spark, sf_dir).where("project_id = 11").select("clip_id", "status", "score")


@register("C3_filter_page", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 10 OFFSET 10")
def filter_page(spark, sf_dir):
    return rel.page(table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey", "c_name"), [F.col("c_custkey")], 2, 10)


@register("C4_project_search", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' AND contains(lower(c_name), '00012')")
def project_search(spark, sf_dir):
    return table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "MACHINERY") & F.contains(F.lower("c_name"), F.lit("00012"))).select("c_custkey", "c_name")


@register("C5_clip_filter", CLIPS + " SELECT clip_id, score FROM clips WHERE status = 'F' AND score BETWEEN 0.1 AND 0.3 AND title IN ('1-URGENT', '2-HIGH')")
def clip_filter(spark, sf_dir):
    c = clips(spark, sf_dir).where((F.col("status") == "F") & F.col("score").between(0.1, 0.3))
    return c.where(F.arrays_overlap(F.array("title"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).select("clip_id", "score")


@register("C6_score_threshold", CLIPS + " SELECT clip_id, score FROM clips WHERE score >= 0.25")
def score_threshold(spark, sf_dir):
    return clips(spark, sf_dir).where("score >= 0.25").select("clip_id", "score")


@register("C7_long_running", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 HOURS")
def long_running(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate").alias("now")).scalar()
    return o.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < now - F.expr("INTERVAL 24 HOURS"))).select("o_orderkey")


@register("C8_keyword_segments", "SELECT conv_id, turn FROM conversations WHERE contains(text, 'the') OR contains(text, 'und')")
def keyword_segments(spark, sf_dir):
    hit = F.exists(F.array(F.lit("the"), F.lit("und")), lambda k: F.contains(F.col("text"), k))
    return table(spark, sf_dir, "conversations").where(hit).select("conv_id", "turn")


@register("C9_any_column_keyword", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'br') OR contains(lower(p_brand), '#12') OR contains(lower(p_type), 'brass')")
def any_column_keyword(spark, sf_dir):
    hit = lambda c, k: F.contains(F.lower(c), F.lit(k))
    return table(spark, sf_dir, "part").where(hit("p_name", "br") | hit("p_brand", "#12") | hit("p_type", "brass")).select("p_partkey")


@register("C10_date_range", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-09-01'")
def date_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.where((F.col("o_orderdate") > F.lit("1995-03-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1995-09-01").cast("timestamp_ntz"))).select("o_orderkey")


@register("C12_valid_segments", """
SELECT user_id, v, event_id FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, event_id, row_number() OVER (PARTITION BY user_id, floor(value) ORDER BY event_id) AS k FROM events WHERE value >= 1) WHERE k = 1""")
def valid_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value >= 1").select("user_id", F.floor("value").alias("v"), "event_id")
    return e.groupBy("user_id", "v").agg(F.min("event_id").alias("event_id"))


@register("C13_short_filter", "SELECT event_id FROM events WHERE value >= least(60, 30) OR event_type IN ('purchase', 'signup')")
def short_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("value") >= 30) | F.col("event_type").isin("purchase", "signup")).select("event_id")


@register("C17_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%0007%'")
def like(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").like("%0007%")).select("c_custkey", "c_name")


@register("C18_active", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def active(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@register("J1_merge_scores", """
WITH s AS (SELECT l_orderkey, arg_max(l_discount, (l_linenumber, l_partkey, l_extendedprice)) AS d FROM lineitem WHERE l_discount > 0.05 GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(d, 0.5) AS final_score FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def merge_scores(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_discount", F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("d"))
    return table(spark, sf_dir, "orders").join(s, "o_orderkey", "left").select("o_orderkey", F.coalesce("d", F.lit(0.5)).alias("final_score"))


@register("J2_merge_titles", """
SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN left(l_returnflag || '-' || l_linestatus, 20) ELSE p_name END AS title
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 20) p ON p_partkey = l_partkey""")
def merge_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return lines.join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.left(F.concat_ws("-", "l_returnflag", "l_linestatus"), F.lit(20))).alias("title"))


@register("J3_positional_zip", """
WITH a AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
b AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'purchase')
SELECT k, o_orderkey, event_id FROM a JOIN b USING (k, p, n)""")
def positional_zip(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    b = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"), "event_id")
    return rel.positional_zip(a, b, ["k"], [F.col("o_orderkey")], [F.col("event_id")])


@register("J5_validate_collections", """
WITH t AS (SELECT o_orderkey AS cid, o_custkey % 100 AS pid, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'no title ' || o_orderkey WHEN o_orderkey % 2 = 0 THEN left(p_name, 9) ELSE p_name END AS title
  FROM orders JOIN part ON p_partkey = o_orderkey % 150 + 1),
c AS (SELECT p_partkey AS clip, p_name AS outline, left(p_name, 9) AS generated FROM part),
h AS (SELECT pid, pos, min(clip) AS clip FROM t JOIN c ON generated = title OR outline = title GROUP BY pid, pos),
k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY pos) AS k, count(*) OVER (PARTITION BY pid) AS n FROM h)
SELECT pid, k, clip FROM k WHERE n >= 2 AND k <= 5""")
def validate_collections(spark, sf_dir):
    """Titles of a collection looked up among the clips, by generated title or outline, the first clip counting;
    collections with two or more keep five. Two equi-joins stand for the either-or."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clip"), F.col("p_name").alias("outline"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("pid"), (F.col("o_orderkey") % 150 + 1).alias("clip"))
    title = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("no title "), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 2 == 0, F.left("outline", F.lit(9))).otherwise(F.col("outline"))
    wanted = rel.ranked(o.join(part, "clip").select("pid", "o_orderkey", title.alias("title")), ["pid"], [F.col("o_orderkey")], "pos").drop("o_orderkey")
    names = part.select("clip", F.explode(F.array_distinct(F.array("outline", F.left("outline", F.lit(9))))).alias("title"))
    found = wanted.join(names.groupBy("title").agg(F.min("clip").alias("clip")), "title").select("pid", "pos", "clip")
    kept = rel.ranked(found, ["pid"], [F.col("pos")], "k").withColumn("n", F.count("*").over(Window.partitionBy("pid")))
    return kept.where("n >= 2 and k <= 5").select("pid", "k", "clip")


@register("J6_ordered_lookup", """
WITH l AS (SELECT l_suppkey AS collection_id, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS pos FROM lineitem),
j AS (SELECT collection_id, pos, l_orderkey, o_orderkey FROM l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey)
SELECT collection_id, count(o_orderkey) = count(*) AS complete, coalesce(list(l_orderkey ORDER BY pos) FILTER (o_orderkey IS NULL), []) AS missing, coalesce(list(o_orderkey ORDER BY pos) FILTER (o_orderkey IS NOT NULL), []) AS clips FROM j GROUP BY collection_id""")
def ordered_lookup(spark, sf_dir):
    """Clips of a collection in its order, and the ids that were not found."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    m = rel.ranked(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("collection_id"), "l_orderkey", "l_linenumber", "l_extendedprice"), ["collection_id"], order, "pos")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("hit"))
    ids = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "l_orderkey")))), lambda x: x["l_orderkey"])
    return m.join(o, "l_orderkey", "left").groupBy("collection_id").agg((F.count("hit") == F.count("*")).alias("complete"), ids(F.col("hit").isNull()).alias("missing"), ids(F.col("hit")).alias("clips"))


@register("J7_collection_totals", "SELECT c_nationkey, count(*) AS n_clips, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey")
def collection_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"))
    j = table(spark, sf_dir, "customer").join(o, "c_custkey").groupBy("c_nationkey")
    return j.agg(F.sum("n").alias("n_clips"), F.round(F.sum("t").cast("double"), 2).alias("total"))


@register("J8_available_clips", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def available_clips(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@register("J9_metadata_id_join", "SELECT event_id, p_partkey FROM events JOIN part ON CAST(p_partkey AS VARCHAR) = json_extract_string(props, '$.k')")
def metadata_id_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.join(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_partkey"), "k").select("event_id", "p_partkey")


@register("J10_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def orphans(spark, sf_dir):
    kept = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return rel.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), kept, "l_orderkey", "o_orderkey")


@register("J11_suffix_join", "SELECT page_id FROM pages WHERE NOT EXISTS (SELECT 1 FROM part WHERE CAST(p_partkey AS VARCHAR) = regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '(\\d+)(\\.html|/)?$', 1))")
def suffix_join(spark, sf_dir):
    base = F.regexp_extract(F.regexp_extract("url", r"^[^?#]*", 0), r"(\d+)(\.html|/)?$", 1)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("base"))
    return table(spark, sf_dir, "pages").select("page_id", base.alias("base")).join(parts, "base", "left_anti").select("page_id")


@register("J12_semi_split", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) THEN 'keep' ELSE 'delete' END AS what FROM orders")
def semi_split(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(ids.withColumn("hit", F.lit(True)), "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("hit"), "keep").otherwise("delete").alias("what"))


@register("J31_project_counts", """
SELECT c_custkey, coalesce(n1, 0) AS n_clips, coalesce(n2, 0) AS n_events FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n1 FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n2 FROM events GROUP BY 1) ON user_id = c_custkey""")
def project_counts(spark, sf_dir):
    children = {"n_clips": table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "n_events": table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")}
    return rel.child_counts(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", children)


@register("J32_pipeline_overview", """
WITH t AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(f, 0) AS f, coalesce(o, 0) AS o, coalesce(p, 0) AS p, (SELECT n FROM t WHERE s = 'F') AS all_f, (SELECT n FROM t WHERE s = 'O') AS all_o, (SELECT n FROM t WHERE s = 'P') AS all_p FROM customer LEFT JOIN p ON o_custkey = c_custkey""")
def pipeline_overview(spark, sf_dir):
    """Every project with its tasks by status, and the totals of each status."""
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])
    total = lambda s: by.agg(F.sum(s)).scalar().alias(f"all_{s}")
    out = table(spark, sf_dir, "customer").select("c_custkey").join(by, "c_custkey", "left")
    return out.select("c_custkey", *[F.coalesce(s, F.lit(0)).alias(s) for s in "fop"], *[total(s) for s in "fop"])


@register("J33_write_back", "SELECT o_orderkey, coalesce(q, o_totalprice) AS price FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def write_back(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_extendedprice", F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("q"))
    return table(spark, sf_dir, "orders").join(first, "o_orderkey", "left").select("o_orderkey", F.coalesce("q", "o_totalprice").alias("price"))


@register("J36_nested_children", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS clip_ids FROM orders GROUP BY o_custkey")
def nested_children(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("clip_ids"))


@register("G1_count_per_project", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def count_per_project(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@register("G2_status_summary", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@register("G10_speaker_statistics", "SELECT role, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY role")
def speaker_statistics(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role is not null").groupBy("role").agg(F.count("*").alias("n"))


@register("G19_step_performance", """
SELECT event_type, round(sum(value), 2) AS total, round(100 * sum(value) / sum(sum(value)) OVER (), 3) AS share, arg_max(event_id, (value, event_id)) AS slowest, arg_min(event_id, (value, event_id)) AS fastest FROM events GROUP BY event_type""")
def step_performance(spark, sf_dir):
    v = F.col("value").cast("decimal(18,6)")
    by = F.struct("value", "event_id")
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(v).cast("double").alias("t"), F.max_by("event_id", by).alias("slowest"), F.min_by("event_id", by).alias("fastest"))
    return g.select("event_type", F.round("t", 2).alias("total"), F.round(100 * F.col("t") / F.sum("t").over(Window.partitionBy()), 3).alias("share"), "slowest", "fastest")


@register("G20_score_diversity", """
WITH s AS (SELECT conv_id, turn, length(text) AS size, 0.5 AS score FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, length(text), round(turn / 10.0, 1) FROM conversations WHERE conv_id % 2 = 1),
w AS (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi, count(*) OVER p AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM s WINDOW p AS (PARTITION BY conv_id)),
v AS (SELECT *, score + CASE WHEN size > 200 THEN 0.15 WHEN size > 100 THEN 0.08 WHEN size > 50 THEN 0.03 ELSE 0 END + 0.2::DOUBLE * (k - 1) / greatest(n - 1, 1) - 0.1 AS moved FROM w)
SELECT conv_id, turn, CAST(CASE WHEN lo = hi AND n > 1 THEN CAST(round(CAST(greatest(0.1, least(1.0, moved)) AS DECIMAL(18, 6)), 2) AS DOUBLE) ELSE score END AS DOUBLE) AS score FROM v""")
def score_diversity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"), F.when(F.col("conv_id") % 2 == 0, 0.5).otherwise(F.round(F.col("turn") / 10.0, 1)).alias("score"))
    return rel.diversify(c, ["conv_id"], "score", [F.col("turn")], F.col("size")).select("conv_id", "turn", "score")


@register("G24_account_kpis", "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_negative, round(avg(c_acctbal), 1) AS mean FROM customer GROUP BY c_mktsegment")
def account_kpis(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.round(F.avg("c_acctbal"), 1).alias("mean"))


@register("K1_paginated", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, CAST(ceil((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') / 20.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paginated(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    got = rel.page(o, [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20)
    total = o.agg(F.count("*").alias("total")).scalar()
    return got.select("o_orderkey", "o_totalprice", total.alias("total"), F.ceil(total / 20).alias("pages"))


@register("K2_rank_and_truncate", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 8""")
def rank_and_truncate(spark, sf_dir):
    best = rel.top(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 8)
    return rel.ranked(best, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "pos").select("o_custkey", "o_orderkey", "pos")


@register("K3_select_final", CLIPS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, clip_id) AS k FROM clips),
s AS (SELECT * FROM r WHERE (score >= 0.25 AND k <= 8) OR k = 1)
SELECT project_id, clip_id, row_number() OVER (PARTITION BY project_id ORDER BY created, clip_id) AS new_id FROM s""")
def select_final(spark, sf_dir):
    r = rel.ranked(clips(spark, sf_dir), ["project_id"], [F.desc("score"), F.col("clip_id")], "k")
    kept = r.where("(score >= 0.25 and k <= 8) or k = 1")
    return rel.ranked(kept, ["project_id"], [F.col("created"), F.col("clip_id")], "new_id").select("project_id", "clip_id", "new_id")


@register("K9_recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey", "o_orderdate")


@register("K12_default_collections", CLIPS + """,
b AS (SELECT *, CASE WHEN score >= 0.3 THEN 'best' WHEN score >= 0.2 THEN 'good' END AS bucket FROM clips),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, bucket ORDER BY clip_id) AS k, count(*) OVER (PARTITION BY project_id, bucket) AS n FROM b WHERE bucket IS NOT NULL)
SELECT project_id, bucket, clip_id FROM r WHERE n >= 2 AND k <= 5""")
def default_collections(spark, sf_dir):
    b = clips(spark, sf_dir).withColumn("bucket", F.when(F.col("score") >= 0.3, "best").when(F.col("score") >= 0.2, "good")).where("bucket is not null")
    b = rel.ranked(b, ["project_id", "bucket"], [F.col("clip_id")], "k").withColumn("n", F.count("*").over(Window.partitionBy("project_id", "bucket")))
    return b.where("n >= 2 and k <= 5").select("project_id", "bucket", "clip_id")


@register("K13_split_by_priority", """
SELECT o_custkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'low' END AS part, count(*) AS n, sum(length(o_orderpriority) * 3 // 10 + 300)::BIGINT AS tokens, sum(length(o_orderpriority) * 3 // 10 + 300) > 1500 AS batched FROM orders GROUP BY ALL""")
def split_by_priority(spark, sf_dir):
    """A project's topics in two parts by priority, and whether a part's tokens call for batches."""
    part = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").otherwise("low")
    tokens = F.sum(tx.estimate_tokens(F.col("o_orderpriority")) + 300)
    return table(spark, sf_dir, "orders").groupBy("o_custkey", part.alias("part")).agg(F.count("*").alias("n"), tokens.alias("tokens"), (tokens > 1500).alias("batched"))


@register("U1_set_differences", """
SELECT 'customer' AS side, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events)
UNION ALL SELECT 'events', k FROM (SELECT user_id AS k FROM events EXCEPT SELECT c_custkey FROM customer)""")
def set_differences(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return a.subtract(b).select(F.lit("customer").alias("side"), "k").unionAll(b.subtract(a).select(F.lit("events").alias("side"), "k"))


@register("U4_concatenate", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def concatenate(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@register("U6_drop_duplicates", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def drop_duplicates(spark, sf_dir):
    return rel.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


UPSERT = """
WITH t AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 > 0), s AS (SELECT user_id AS k, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1)"""


@register("B5_upsert", UPSERT + " SELECT t.k, CASE WHEN s.k IS NULL THEN t.v ELSE s.v END AS v FROM t LEFT JOIN s USING (k) UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM t)")
def upsert(spark, sf_dir):
    t = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").cast("double").alias("v"))
    return rel.upsert(t, s, ["k"], ["v"])


@register("B7_insert_if_absent", UPSERT + " SELECT k, v FROM t UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM t)")
def insert_if_absent(spark, sf_dir):
    t = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").cast("double").alias("v"))
    return t.unionByName(s.join(t, "k", "left_anti"))


@register("B9_cascade_delete", """
WITH p AS (SELECT c_custkey AS project, CASE WHEN c_nationkey < 8 THEN 'completed' ELSE 'active' END AS status FROM customer), asked AS (SELECT c_custkey AS project FROM customer WHERE c_acctbal < 2000),
t AS (SELECT user_id AS project, event_id AS id, CASE WHEN event_type = 'error' AND value > 300 THEN 'processing' ELSE 'done' END AS state FROM events),
gone AS (SELECT project FROM asked WHERE NOT (project IN (SELECT project FROM t WHERE state = 'processing') AND project IN (SELECT project FROM p WHERE status NOT IN ('completed', 'failed'))))
SELECT 'project' AS name, project AS id FROM p WHERE project NOT IN (SELECT project FROM gone) UNION ALL SELECT 'task', id FROM t WHERE project NOT IN (SELECT project FROM gone)
UNION ALL SELECT 'clip', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT project FROM gone) UNION ALL SELECT 'collection', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT project FROM gone)""")
def cascade_delete(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    projects = c.select(F.col("c_custkey").alias("project"), F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 8, "completed").otherwise("active").alias("status"))
    busy = (F.col("event_type") == "error") & (F.col("value") > 300)
    tasks = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("id"), F.when(busy, "processing").otherwise("done").alias("state"))
    children = {"clip": table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id")), "collection": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project"), F.col("s_suppkey").alias("id"))}
    left = rel.delete_projects(projects, c.where("c_acctbal < 2000").select(F.col("c_custkey").alias("project")), tasks, children)
    parts = [df.select(F.lit(name).alias("name"), "id") for name, df in left.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@register("B12_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))


@register("K10_clip_sorts", CLIPS + """
SELECT project_id, clip_id, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, clip_id) AS by_score, row_number() OVER (PARTITION BY project_id ORDER BY created, clip_id) AS by_time,
  row_number() OVER (PARTITION BY project_id ORDER BY created DESC, clip_id) AS newest FROM clips""")
def clip_sorts(spark, sf_dir):
    """The places of a project's clips in each order that they can be shown in."""
    place = lambda *by: F.row_number().over(Window.partitionBy("project_id").orderBy(*by, "clip_id"))
    return clips(spark, sf_dir).select("project_id", "clip_id", place(F.desc("score")).alias("by_score"), place("created").alias("by_time"), place(F.desc("created")).alias("newest"))
