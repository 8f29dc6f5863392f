"""Interval queries: a user's events are the captions of a medium; purchases stand for segments, errors for silences
and views for keyframes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlake.functions import text as tx
from spanlake.operators import intervals, joins
from spanlake.plans.catalogue import register
from spanlake.sources.captions import from_events

CAPTIONS = """
WITH captions AS (
  SELECT user_id AS media_id, event_id, event_type, (epoch_us(ts) // 1000) AS start_ms,
         (epoch_us(ts) // 1000) + CAST(floor(value * 1000) AS BIGINT) AS end_ms
  FROM events)"""
SEGMENTS = CAPTIONS + """,
segments AS (SELECT media_id, event_id AS segment_id, start_ms AS l_start, end_ms AS l_end FROM captions WHERE event_type = 'purchase'),
others AS (SELECT media_id, event_id, event_type, start_ms AS r_start, end_ms AS r_end FROM captions WHERE event_type <> 'purchase'),
silences AS (SELECT media_id, event_id AS silence_id, start_ms AS r_start, end_ms AS r_end FROM captions WHERE event_type = 'error'),
keyframes AS (SELECT DISTINCT media_id, start_ms AS t FROM captions WHERE event_type = 'view')"""
#: Width of the time bins of overlap joins: about the longest event.
BIN = 600_000
#: Time slices of a medium (ten days), so that one with most of all events is no single task.
SLICE = 864_000_000


def segments(spark, sf_dir):
    return from_events(spark, sf_dir).where("event_type = 'purchase'").select("media_id", F.col("event_id").alias("segment_id"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))


def others(spark, sf_dir, kind="event_type <> 'purchase'", ident="event_id"):
    return from_events(spark, sf_dir).where(kind).select("media_id", F.col("event_id").alias(ident), "event_type", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))


def silences(spark, sf_dir):
    return others(spark, sf_dir, "event_type = 'error'", "silence_id").drop("event_type")


def keyframes(spark, sf_dir):
    return from_events(spark, sf_dir).where("event_type = 'view'").select("media_id", F.col("start_ms").alias("t")).distinct()


def merged_sql(gap: int, source: str = "captions") -> str:
    return f""",
marked AS (
  SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, event_id
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS fresh FROM {source}),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_segments FROM numbered GROUP BY media_id, island)"""


@register("F1_merge_overlapping", CAPTIONS + merged_sql(0) + " SELECT * FROM merged")
def merge_overlapping(spark, sf_dir):
    return intervals.merge(from_events(spark, sf_dir), ["media_id"], 0, order=["event_id"])


@register("F2_merge_segments", CAPTIONS + merged_sql(600_000) + " SELECT * FROM merged")
def merge_segments(spark, sf_dir):
    return intervals.merge(from_events(spark, sf_dir), ["media_id"], 600_000, order=["event_id"], slice_ms=SLICE)


@register("F3_merge_removed", CAPTIONS + ", s AS (SELECT * FROM captions WHERE event_type = 'error')" + merged_sql(300, "s") + " SELECT * FROM merged")
def merge_removed(spark, sf_dir):
    return intervals.merge(from_events(spark, sf_dir).where("event_type = 'error'"), ["media_id"], 300, order=["event_id"])


@register("F4_effective_segments", SEGMENTS + ", s AS (SELECT * FROM captions WHERE event_type <> 'purchase' AND event_id % 3 = 0)" + merged_sql(0, "s") + """,
cuts AS (
  SELECT g.media_id, segment_id, l_start, l_end, greatest(l_start, start_ms) AS a, least(l_end, end_ms) AS b
  FROM segments g JOIN merged m ON g.media_id = m.media_id AND m.start_ms < l_end AND m.end_ms > l_start
  UNION ALL SELECT media_id, segment_id, l_start, l_end, l_end, l_end FROM segments),
pieces AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY media_id, segment_id ORDER BY a, b), l_start) AS start_ms FROM cuts),
padded AS (SELECT media_id, segment_id, greatest(l_start, start_ms - 200) AS s, least(l_end, a + 200) AS e FROM pieces WHERE a > start_ms),
fresh AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY media_id, segment_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM padded),
numbered2 AS (SELECT *, sum(f) OVER (PARTITION BY media_id, segment_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM fresh),
touching AS (SELECT media_id, segment_id, min(s) AS start_ms, max(e) AS end_ms FROM numbered2 GROUP BY media_id, segment_id, i)
SELECT media_id, segment_id, start_ms, end_ms FROM touching WHERE end_ms - start_ms > 500 AND media_id IN (SELECT media_id FROM s WHERE end_ms > start_ms)
UNION ALL SELECT media_id, segment_id, l_start, l_end FROM segments WHERE media_id NOT IN (SELECT media_id FROM s WHERE end_ms > start_ms)""")
def effective_segments(spark, sf_dir):
    left = segments(spark, sf_dir).select("media_id", "segment_id", F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms"))
    removed = from_events(spark, sf_dir).where("event_type <> 'purchase' and event_id % 3 = 0")
    return intervals.effective(left, removed, ["media_id"], "segment_id", BIN)


def _orphans_sql(gap: int, where: str) -> str:
    return SEGMENTS + f""",
orphans AS (SELECT media_id, event_id, event_type, r_start AS start_ms, r_end AS end_ms FROM others o WHERE NOT EXISTS (
  SELECT 1 FROM segments s WHERE s.media_id = o.media_id AND o.r_start < s.l_end AND o.r_end > s.l_start)){merged_sql(gap, "orphans")},
k AS (SELECT *, row_number() OVER (PARTITION BY media_id, island ORDER BY start_ms, end_ms, event_id) AS k FROM numbered)
SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, list(left(event_type, 40) ORDER BY k) FILTER (k <= 3) AS samples FROM k GROUP BY media_id, island HAVING {where}"""


def _orphans(spark, sf_dir):
    right = others(spark, sf_dir)
    covered = joins.overlap_join(segments(spark, sf_dir), right, ["media_id"], BIN, longest=BIN).select("event_id").distinct()
    return right.join(covered, "event_id", "left_anti").withColumnsRenamed({"r_start": "start_ms", "r_end": "end_ms"})


@register("F5_coverage_gaps", _orphans_sql(1000, "max(end_ms) - min(start_ms) >= 5000"))
def coverage_gaps(spark, sf_dir):
    return intervals.gaps_with_samples(_orphans(spark, sf_dir), ["media_id"], 1000, "event_type", ["event_id"]).where("end_ms - start_ms >= 5000")


@register("F5b_simple_coverage_gaps", _orphans_sql(2000, "max(end_ms) - min(start_ms) >= 10000"))
def simple_coverage_gaps(spark, sf_dir):
    return intervals.gaps_with_samples(_orphans(spark, sf_dir), ["media_id"], 2000, "event_type", ["event_id"]).where("end_ms - start_ms >= 10000")


@register("F6_complement", CAPTIONS + """,
g AS (
  SELECT media_id, coalesce(max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, start_ms AS end_ms FROM captions
  UNION ALL SELECT media_id, max(end_ms), max(end_ms) + 60000 FROM captions GROUP BY media_id)
SELECT * FROM g WHERE end_ms - start_ms > 500""")
def complement(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    total = rows.groupBy("media_id").agg((F.max("end_ms") + 60_000).alias("total"))
    return intervals.complement(rows.join(total, "media_id"), ["media_id"], "total", least=500, slice_ms=SLICE)


@register("F7_pad_without_overlap", CAPTIONS + """,
p AS (SELECT *, greatest(start_ms - 20000, 0) AS lo, end_ms + 20000 AS hi FROM captions),
n AS (SELECT *, lag(hi) OVER w AS ph, lead(lo) OVER w AS nl FROM p WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, event_id))
SELECT media_id, event_id, CASE WHEN ph > lo THEN (ph + lo) // 2 ELSE lo END AS padded_start, CASE WHEN nl < hi THEN (hi + nl) // 2 ELSE hi END AS padded_end FROM n""")
def pad_without_overlap(spark, sf_dir):
    out = intervals.pad_without_overlap(from_events(spark, sf_dir), ["media_id"], 20_000, ["event_id"])
    return out.select("media_id", "event_id", "padded_start", "padded_end")


@register("F11_fix_overlapping_timeline", CAPTIONS + """,
n AS (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns FROM captions WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, event_id))
SELECT media_id, event_id, CASE WHEN pe > start_ms THEN (pe + start_ms) // 2 + 100 ELSE start_ms END AS fixed_start,
  CASE WHEN ns < end_ms THEN (end_ms + ns) // 2 - 100 ELSE end_ms END AS fixed_end FROM n""")
def fix_overlapping(spark, sf_dir):
    return intervals.fix_overlaps(from_events(spark, sf_dir), ["media_id"], ["start_ms", "event_id"]).select("media_id", "event_id", "fixed_start", "fixed_end")


@register("F8_removed_sections", SEGMENTS + """,
s AS (SELECT media_id, segment_id, segment_id AS event_id, greatest(l_start, r_start) AS start_ms, least(l_end, r_end) AS end_ms FROM segments JOIN silences USING (media_id)
  WHERE r_start < l_end AND r_end > l_start AND least(l_end, r_end) - greatest(l_start, r_start) >= 500),
m AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY media_id, segment_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 300 THEN 0 ELSE 1 END AS f FROM s),
n AS (SELECT *, sum(f) OVER (PARTITION BY media_id, segment_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT media_id, segment_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_segments FROM n GROUP BY media_id, segment_id, i""")
def removed_sections(spark, sf_dir):
    pairs = joins.overlap_join(segments(spark, sf_dir), silences(spark, sf_dir), ["media_id"], BIN, longest=BIN)
    hit = pairs.select("media_id", "segment_id", F.greatest("l_start", "r_start").alias("start_ms"), F.least("l_end", "r_end").alias("end_ms")).where("end_ms - start_ms >= 500")
    return intervals.merge(hit, ["media_id", "segment_id"], 300)


def _sessions_sql(gap: int) -> str:
    return f""",
f AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w < {gap} THEN 0 ELSE 1 END AS fresh FROM captions WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f)"""


@register("F18_time_ranges", CAPTIONS + _sessions_sql(30_000) + " SELECT media_id, CAST(session AS BIGINT) AS session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM s GROUP BY media_id, session")
def time_ranges(spark, sf_dir):
    s = intervals.sessions(from_events(spark, sf_dir), ["media_id"], 30_000, ["event_id"], slice_ms=SLICE)
    return s.groupBy("media_id", "session").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


@register("F19_gap_phrases", CAPTIONS + _sessions_sql(60_000) + """,
p AS (SELECT media_id, string_agg(event_type, ' ' ORDER BY start_ms, event_id) AS phrase FROM s GROUP BY media_id, session),
c AS (SELECT media_id, phrase, count(*) AS n FROM p WHERE length(phrase) BETWEEN 5 AND 30 GROUP BY ALL)
SELECT media_id, phrase, n, rk FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY n DESC, phrase) AS rk FROM c) WHERE rk <= 3""")
def gap_phrases(spark, sf_dir):
    s = intervals.sessions(from_events(spark, sf_dir), ["media_id"], 60_000, ["event_id"])
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "event_id", "event_type")))
    p = s.groupBy("media_id", "session").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), " ").alias("phrase"))
    c = p.where(F.length("phrase").between(5, 30)).groupBy("media_id", "phrase").agg(F.count("*").alias("n"))
    return c.withColumn("rk", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("n"), "phrase"))).where("rk <= 3")


@register("F20_pause_points", """
WITH c AS (SELECT conv_id, turn, text, turn * 10000 AS start_ms, turn * 10000 + length(text) * 7 AS end_ms FROM conversations),
n AS (SELECT *, lead(start_ms) OVER w - end_ms AS pause_ms, lead(text) OVER w AS nt FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, pause_ms, right(text, 50) AS text_before, left(nt, 50) AS text_after FROM n WHERE pause_ms >= 8000""")
def pause_points(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text", (F.col("turn") * 10_000).alias("start_ms"))
    c = c.withColumn("pause_ms", F.lead("start_ms").over(w) - F.col("start_ms") - F.length("text") * 7).withColumn("next", F.lead("text").over(w))
    return c.where("pause_ms >= 8000").select("conv_id", "turn", "pause_ms", F.right("text", F.lit(50)).alias("text_before"), F.left("next", F.lit(50)).alias("text_after"))


@register("F21_semantic_boundaries", CAPTIONS + """,
n AS (SELECT *, lead(start_ms) OVER w - end_ms AS pause_ms, lead(event_type) OVER w AS next_type FROM captions WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, event_id)),
s AS (SELECT *, len(list_intersect(list_distinct(string_split(event_type, '')), list_distinct(string_split(next_type, '')))) / CAST(len(list_distinct(string_split(event_type || next_type, ''))) AS DOUBLE) AS sim FROM n)
SELECT media_id, event_id, CASE WHEN pause_ms > 18000000 THEN 'pause' ELSE 'change' END AS kind FROM s WHERE pause_ms > 18000000 OR (pause_ms > 7200000 AND sim < 0.4)""")
def semantic_boundaries(spark, sf_dir):
    """A pause, or a shorter one with little in common between the texts (shared characters over all) on both sides."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "event_id")
    n = from_events(spark, sf_dir).withColumn("pause_ms", F.lead("start_ms").over(w) - F.col("end_ms")).withColumn("next", F.lead("event_type").over(w))
    sim = tx.jaccard(F.array_distinct(F.split("event_type", "")), F.array_distinct(F.split("next", "")))
    n = n.where((F.col("pause_ms") > 18_000_000) | ((F.col("pause_ms") > 7_200_000) & (sim < 0.4)))
    return n.select("media_id", "event_id", F.when(F.col("pause_ms") > 18_000_000, "pause").otherwise("change").alias("kind"))


@register("F25_sliding_windows", """
SELECT o_orderkey, CAST(i * 80 AS BIGINT) AS w_start, least(CAST(i * 80 + 100 AS DOUBLE), total) AS w_end FROM (
  SELECT o_orderkey, floor(o_totalprice / 100) AS total, unnest(range(0, CAST(greatest(1, ceil((floor(o_totalprice / 100) - 20) / 80)) AS BIGINT))) AS i FROM orders)""")
def sliding_windows(spark, sf_dir):
    total = F.floor(F.col("o_totalprice") / 100).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", total.alias("total"))
    n = F.greatest(F.lit(1), F.ceil((F.col("total") - 20) / 80))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select("o_orderkey", (F.col("i") * 80).alias("w_start"), F.least(F.col("i") * 80.0 + 100, F.col("total")).alias("w_end"))


@register("F26_equal_parts", CAPTIONS + """,
t AS (SELECT media_id, min(start_ms) AS lo, max(end_ms) - min(start_ms) AS total FROM captions GROUP BY media_id)
SELECT media_id, i, lo + i * least(total // 4, 300000) AS start_ms, lo + (i + 1) * least(total // 4, 300000) AS end_ms FROM t, range(0, 4) r(i)""")
def equal_parts(spark, sf_dir):
    t = from_events(spark, sf_dir).groupBy("media_id").agg(F.min("start_ms").alias("lo"), (F.max("end_ms") - F.min("start_ms")).alias("total"))
    part = F.least(F.floor(F.col("total") / 4), F.lit(300_000))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return t.select("media_id", "i", (F.col("lo") + F.col("i") * part).alias("start_ms"), (F.col("lo") + (F.col("i") + 1) * part).alias("end_ms"))


@register("F27_voiced_runs", """
WITH p AS (SELECT user_id, value > 50 AS voiced, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
q AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM p WHERE voiced)
SELECT user_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM q GROUP BY user_id, run""")
def voiced_runs(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("voiced", F.col("value") > 50)
    return intervals.runs(events, ["user_id"], "voiced", ["ts", "event_id"])


@register("F30_stride_sample", """
WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, pos FROM p WHERE n <= 20 OR (pos * 20) // n <> ((pos - 1) * 20) // n OR pos = 0""")
def stride_sample(spark, sf_dir):
    w = Window.partitionBy("user_id")
    p = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("n"))
    step = lambda c: F.floor(c * 20 / F.col("n"))
    return p.where((F.col("n") <= 20) | (F.col("pos") == 0) | (step(F.col("pos")) != step(F.col("pos") - 1))).select("event_id", "user_id", "pos")


@register("F34_completeness_flags", CAPTIONS + """,
n AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, event_id) AS gap FROM captions)
SELECT media_id, event_id, CASE WHEN gap < 0 THEN 'overlapping' WHEN gap < 120000 THEN 'tight' WHEN event_type = 'click' THEN 'generic' WHEN end_ms - start_ms < 30000 THEN 'short' ELSE 'ok' END AS flag FROM n""")
def completeness_flags(spark, sf_dir):
    w = Window.partitionBy("media_id").orderBy("start_ms", "event_id")
    n = from_events(spark, sf_dir).withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(w))
    flag = F.when(F.col("gap") < 0, "overlapping").when(F.col("gap") < 120_000, "tight").when(F.col("event_type") == "click", "generic")
    return n.select("media_id", "event_id", flag.when(F.col("end_ms") - F.col("start_ms") < 30_000, "short").otherwise("ok").alias("flag"))


@register("J13_overlap_join", SEGMENTS + " SELECT media_id, segment_id, event_id FROM segments JOIN others USING (media_id) WHERE r_start < l_end AND r_end > l_start")
def overlap_join(spark, sf_dir):
    return joins.overlap_join(segments(spark, sf_dir), others(spark, sf_dir), ["media_id"], BIN, longest=BIN).select("media_id", "segment_id", "event_id")


@register("J14_containment_join", SEGMENTS + " SELECT media_id, segment_id, event_id FROM segments JOIN others USING (media_id) WHERE r_start >= l_start AND r_end <= l_end")
def containment_join(spark, sf_dir):
    return joins.overlap_join(segments(spark, sf_dir), others(spark, sf_dir), ["media_id"], BIN, longest=BIN, how="within").select("media_id", "segment_id", "event_id")


@register("J15_first_contained_else_overlapping", SEGMENTS + """
SELECT media_id, segment_id, event_type AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY CASE WHEN r_start >= l_start AND r_end <= l_end THEN 0 ELSE 1 END, r_start, event_id) AS k
  FROM segments JOIN others USING (media_id) WHERE r_start < l_end AND r_end > l_start) WHERE k = 1""")
def first_contained(spark, sf_dir):
    pairs = joins.overlap_join(segments(spark, sf_dir), others(spark, sf_dir), ["media_id"], BIN, longest=BIN)
    inside = (F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end"))
    return joins.first_or_last(pairs, ["media_id", "segment_id"], F.col("event_type"), [F.col("r_start"), F.col("event_id")], inside)


@register("J16_closed_overlap_join", SEGMENTS + " SELECT media_id, segment_id, event_id FROM segments JOIN others USING (media_id) WHERE r_start <= l_end AND r_end >= l_start")
def closed_overlap_join(spark, sf_dir):
    return joins.overlap_join(segments(spark, sf_dir), others(spark, sf_dir), ["media_id"], BIN, longest=BIN, closed=True).select("media_id", "segment_id", "event_id")


@register("J17_gap_entries", SEGMENTS + """,
gaps AS (SELECT media_id, segment_id, l_end AS a, lead(l_start) OVER (PARTITION BY media_id ORDER BY l_start, segment_id) AS b FROM segments)
SELECT media_id, segment_id, event_id FROM gaps JOIN others USING (media_id) WHERE r_start >= a AND r_end <= b""")
def gap_entries(spark, sf_dir):
    w = Window.partitionBy("media_id").orderBy("l_start", "segment_id")
    gaps = segments(spark, sf_dir).select("media_id", "segment_id", F.col("l_end").alias("a"), F.lead("l_start").over(w).alias("l_end")).withColumnRenamed("a", "l_start").where("l_end >= l_start")
    return joins.overlap_join(gaps, others(spark, sf_dir), ["media_id"], 144 * BIN, how="within", longest=144 * BIN).select("media_id", "segment_id", "event_id")


@register("J20_align_start", SEGMENTS + """
SELECT s.segment_id, coalesce(max(o.r_start), any_value(l_start)) AS aligned FROM segments s LEFT JOIN others o ON o.media_id = s.media_id AND o.r_start <= s.l_start GROUP BY s.segment_id""")
def align_start(spark, sf_dir):
    right = others(spark, sf_dir).withColumn("aligned", F.col("r_start"))
    return joins.asof(segments(spark, sf_dir), right, ["media_id"], "l_start", "r_start", "aligned", slice_ms=SLICE).select("segment_id", F.coalesce("aligned", "l_start").alias("aligned"))


@register("J21_align_end", SEGMENTS + """
SELECT s.segment_id, coalesce(min(o.r_end), any_value(l_end)) AS aligned FROM segments s LEFT JOIN others o ON o.media_id = s.media_id AND o.r_end >= s.l_end GROUP BY s.segment_id""")
def align_end(spark, sf_dir):
    right = others(spark, sf_dir).withColumn("aligned", F.col("r_end"))
    return joins.asof(segments(spark, sf_dir), right, ["media_id"], "l_end", "r_end", "aligned", "forward").select("segment_id", F.coalesce("aligned", "l_end").alias("aligned"))


NEAREST = """,
n AS (SELECT s.media_id, segment_id, l_start, l_end,
  max(t) FILTER (t <= l_start) AS sp, min(t) FILTER (t >= l_start) AS sn, max(t) FILTER (t <= l_end) AS ep, min(t) FILTER (t >= l_end) AS en
  FROM segments s LEFT JOIN keyframes k ON k.media_id = s.media_id GROUP BY ALL),
m AS (SELECT *, coalesce(sp, sn) AS spc, coalesce(sn, sp) AS snc, coalesce(ep, en) AS epc, coalesce(en, ep) AS enc FROM n),
q AS (SELECT *, CASE WHEN abs(l_start - spc) <= abs(snc - l_start) THEN spc ELSE snc END AS sc, CASE WHEN abs(l_end - epc) <= abs(enc - l_end) THEN epc ELSE enc END AS ec FROM m)"""


@register("J22_nearest_keyframe", SEGMENTS + NEAREST + " SELECT segment_id, spc AS previous, snc AS next, sc AS nearest FROM q")
def nearest_keyframe(spark, sf_dir):
    return joins.nearest(segments(spark, sf_dir), keyframes(spark, sf_dir), ["media_id"], "l_start", "t").select("segment_id", "previous", "next", "nearest")


def _aligned(spark, sf_dir, strategy):
    clips = segments(spark, sf_dir).withColumnsRenamed({"l_start": "start_ms", "l_end": "end_ms"})
    keys = keyframes(spark, sf_dir)
    for side in ("start", "end"):
        clips = joins.nearest(clips, keys, ["media_id"], f"{side}_ms", "t")
        clips = clips.withColumnsRenamed({k: f"{side}_ms_{k}" for k in ("previous", "next", "nearest")})
    return joins.align(clips, strategy, 5_000)


def _aligned_sql(start: str, end: str) -> str:
    return SEGMENTS + NEAREST + f""",
z AS (SELECT segment_id, l_start, l_end, CASE WHEN {start} IS NULL THEN greatest(0, l_start - 2000) ELSE greatest(least({start}, l_start + 5000), l_start - 5000) END AS a,
  CASE WHEN {end} IS NULL THEN greatest(0, l_end + 2000) ELSE greatest(least({end}, l_end + 5000), l_end - 5000) END AS b FROM q)
SELECT segment_id, CASE WHEN a < b THEN a ELSE l_start END AS aligned_start, CASE WHEN a < b THEN b ELSE l_end END AS aligned_end FROM z"""


for _name, _s, _e in (("balanced", "sc", "ec"), ("content_preserving", "spc", "enc"), ("strict", "snc", "epc"), ("previous", "spc", "epc"), ("next", "snc", "enc")):
    register(f"J23_align_{_name}", _aligned_sql(_s, _e))(lambda spark, sf_dir, how=_name: _aligned(spark, sf_dir, how).select("segment_id", "aligned_start", "aligned_end"))


@register("J24_align_clips", _aligned_sql("sc", "ec").replace("SELECT segment_id, CASE", "SELECT segment_id, l_start AS original_start, l_end AS original_end, (CASE WHEN a < b THEN b - a ELSE l_end - l_start END) - (l_end - l_start) AS expansion, CASE"))
def align_clips(spark, sf_dir):
    a = _aligned(spark, sf_dir, "balanced")
    grown = F.col("aligned_end") - F.col("aligned_start") - (F.col("end_ms") - F.col("start_ms"))
    return a.select("segment_id", F.col("start_ms").alias("original_start"), F.col("end_ms").alias("original_end"), grown.alias("expansion"), "aligned_start", "aligned_end")


@register("J25_map_to_clip", SEGMENTS + """
SELECT segment_id, event_id, greatest(r_start, l_start) - l_start AS local_start, least(r_end, l_end) - l_start AS local_end
FROM segments JOIN others USING (media_id) WHERE r_start < l_end AND r_end > l_start AND least(r_end, l_end) - greatest(r_start, l_start) > 300""")
def map_to_clip(spark, sf_dir):
    p = joins.overlap_join(segments(spark, sf_dir), others(spark, sf_dir), ["media_id"], BIN, longest=BIN)
    p = p.select("segment_id", "event_id", (F.greatest("r_start", "l_start") - F.col("l_start")).alias("local_start"), (F.least("r_end", "l_end") - F.col("l_start")).alias("local_end"))
    return p.where("local_end - local_start > 300")


@register("J30_conflicts", SEGMENTS + """
SELECT DISTINCT segment_id FROM segments s WHERE EXISTS (SELECT 1 FROM others o WHERE o.media_id = s.media_id AND o.r_start < s.l_end + 500 AND o.r_end > s.l_start - 500)""")
def conflicts(spark, sf_dir):
    return joins.overlap_join(segments(spark, sf_dir), others(spark, sf_dir), ["media_id"], BIN, longest=BIN, margin=500).select("segment_id").distinct()


@register("C14_silences_in_segments", SEGMENTS + """
SELECT segment_id, silence_id, greatest(l_start, r_start) AS start_ms, least(l_end, r_end) AS end_ms FROM segments JOIN silences USING (media_id)
WHERE r_start < l_end AND r_end > l_start AND least(l_end, r_end) - greatest(l_start, r_start) >= 500""")
def silences_in_segments(spark, sf_dir):
    p = joins.overlap_join(segments(spark, sf_dir), silences(spark, sf_dir), ["media_id"], BIN, longest=BIN)
    return p.select("segment_id", "silence_id", F.greatest("l_start", "r_start").alias("start_ms"), F.least("l_end", "r_end").alias("end_ms")).where("end_ms - start_ms >= 500")


@register("G4_total_duration", CAPTIONS + " SELECT media_id, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS total_ms FROM captions GROUP BY media_id")
def total_duration(spark, sf_dir):
    return from_events(spark, sf_dir).groupBy("media_id").agg(F.sum(intervals.duration()).alias("total_ms"))


@register("G5_weighted_confidence", CAPTIONS + """
SELECT media_id, round(CAST(sum((event_id % 100) * greatest(1, end_ms - start_ms)) AS DOUBLE) / CAST(sum(greatest(1, end_ms - start_ms)) AS DOUBLE), 6) AS confidence FROM captions GROUP BY media_id""")
def weighted_confidence(spark, sf_dir):
    d = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    return from_events(spark, sf_dir).groupBy("media_id").agg(F.round(F.sum(F.col("event_id") % 100 * d).cast("double") / F.sum(d).cast("double"), 6).alias("confidence"))


COVERED = SEGMENTS + """,
c AS (SELECT DISTINCT o.media_id, event_id FROM segments s JOIN others o ON o.media_id = s.media_id AND o.r_start < s.l_end AND o.r_end > s.l_start),
k AS (SELECT media_id, count(*) AS covered FROM c GROUP BY media_id), t AS (SELECT media_id, count(*) AS total FROM others GROUP BY media_id)"""


@register("G6_coverage_ratio", COVERED + " SELECT media_id, total, coalesce(covered, 0) AS covered, round(coalesce(covered, 0) / total, 4) AS ratio FROM t LEFT JOIN k USING (media_id)")
def coverage_ratio(spark, sf_dir):
    right = others(spark, sf_dir)
    covered = joins.overlap_join(segments(spark, sf_dir), right, ["media_id"], BIN, longest=BIN).groupBy("media_id").agg(F.count_distinct("event_id").alias("covered"))
    total = right.groupBy("media_id").agg(F.count("*").alias("total")).join(covered, "media_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return total.select("media_id", "total", "covered", F.round(F.col("covered") / F.col("total"), 4).alias("ratio"))


@register("G7_clip_coverage", SEGMENTS + """,
t AS (SELECT media_id, count(*) AS total FROM others GROUP BY media_id),
k AS (SELECT media_id, segment_id, count(DISTINCT event_id) AS covered FROM segments JOIN others USING (media_id) WHERE r_start < l_end AND r_end > l_start GROUP BY ALL)
SELECT segment_id, covered, round(covered / total, 4) AS ratio FROM k JOIN t USING (media_id)""")
def clip_coverage(spark, sf_dir):
    right = others(spark, sf_dir)
    k = joins.overlap_join(segments(spark, sf_dir), right, ["media_id"], BIN, longest=BIN).groupBy("media_id", "segment_id").agg(F.count_distinct("event_id").alias("covered"))
    k = k.join(right.groupBy("media_id").agg(F.count("*").alias("total")), "media_id")
    return k.select("segment_id", "covered", F.round(F.col("covered") / F.col("total"), 4).alias("ratio"))


@register("G8_keyframe_statistics", SEGMENTS + """,
d AS (SELECT media_id, t, t - lag(t) OVER (PARTITION BY media_id ORDER BY t) AS step FROM keyframes)
SELECT media_id, count(*) AS n, round(CAST(sum(step) AS DOUBLE) / count(step), 3) AS mean_step, min(step) AS least_step, max(step) AS most_step, min(t) AS first_t, max(t) AS last_t FROM d GROUP BY media_id""")
def keyframe_statistics(spark, sf_dir):
    d = keyframes(spark, sf_dir).withColumn("step", F.col("t") - F.lag("t").over(Window.partitionBy("media_id").orderBy("t")))
    return d.groupBy("media_id").agg(
        F.count("*").alias("n"), F.round(F.sum("step").cast("double") / F.nullif(F.count("step"), F.lit(0)), 3).alias("mean_step"),
        F.min("step").alias("least_step"), F.max("step").alias("most_step"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )


@register("G9_dominant_speaker", SEGMENTS + """,
p AS (SELECT segment_id, event_type, count(*) AS n, min(r_start) AS first_at FROM segments JOIN others USING (media_id) WHERE r_start < l_end AND r_end > l_start GROUP BY ALL)
SELECT segment_id, event_type AS speaker, n FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, first_at, event_type DESC) AS k FROM p) WHERE k = 1""")
def dominant_speaker(spark, sf_dir):
    p = joins.overlap_join(segments(spark, sf_dir), others(spark, sf_dir), ["media_id"], BIN, longest=BIN).groupBy("segment_id", "event_type").agg(F.count("*").alias("n"), F.min("r_start").alias("first_at"))
    best = F.max(F.struct("n", -F.col("first_at"), "event_type")).alias("b")
    return p.groupBy("segment_id").agg(best).select("segment_id", F.col("b.event_type").alias("speaker"), "b.n")


@register("G22_timeline_summary", CAPTIONS + " SELECT media_id, count(*) AS n, arg_max(end_ms, (start_ms, event_id)) - min(start_ms) AS span_ms FROM captions GROUP BY media_id")
def timeline_summary(spark, sf_dir):
    last = F.max_by("end_ms", F.struct("start_ms", "event_id"))
    return from_events(spark, sf_dir).groupBy("media_id").agg(F.count("*").alias("n"), (last - F.min("start_ms")).alias("span_ms"))


@register("G25_density_confidence", SEGMENTS + """
SELECT s.segment_id, round(least(1.0, count(o.event_id) / (greatest(1, l_end - l_start) / 1000.0)), 4) AS confidence FROM segments s
LEFT JOIN others o ON o.media_id = s.media_id AND o.r_start >= l_start AND o.r_end <= l_end GROUP BY s.segment_id, l_start, l_end""")
def density_confidence(spark, sf_dir):
    left = segments(spark, sf_dir)
    n = joins.overlap_join(left, others(spark, sf_dir), ["media_id"], BIN, how="within", longest=BIN).groupBy("segment_id").agg(F.count("*").alias("n"))
    seconds = F.greatest(F.lit(1), F.col("l_end") - F.col("l_start")) / 1000.0
    return left.join(n, "segment_id", "left").select("segment_id", F.round(F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / seconds), 4).alias("confidence"))


@register("G27_skip_ratio", CAPTIONS + merged_sql(0) + """
SELECT media_id, round((max(end_ms) - min(start_ms) - sum(end_ms - start_ms)) / CAST(max(end_ms) - min(start_ms) AS DOUBLE), 6) AS skip_ratio FROM merged GROUP BY media_id HAVING max(end_ms) > min(start_ms)""")
def skip_ratio(spark, sf_dir):
    m = intervals.merge(from_events(spark, sf_dir), ["media_id"], 0, order=["event_id"])
    total = F.max("end_ms") - F.min("start_ms")
    m = m.groupBy("media_id").agg(total.alias("total"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech")).where("total > 0")
    return m.select("media_id", F.round((F.col("total") - F.col("speech")) / F.col("total").cast("double"), 6).alias("skip_ratio"))
