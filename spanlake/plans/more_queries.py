"""Queries over sources and sinks, topics, identifiers and collections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlake.functions import text as tx
from spanlake.operators import intervals, joins, mining, topics
from spanlake.operators import relational as rel
from spanlake.plans.catalogue import register
from spanlake.plans.interval_queries import BIN, SEGMENTS, others, segments, silences
from spanlake.plans.interval_queries import CAPTIONS as EVENTS
from spanlake.plans.relational_queries import table
from spanlake.plans.text_queries import CAPTIONS, CLUSTERS, KEYWORDS, STOP, STOP_SQL, TITLE, WORDS, _clusters, captions
from spanlake.sources import files, srt, stages
from spanlake.sources.captions import from_events
from spanlake.storage import checkpoints, shared_folder


def folder(spark) -> str:
    """A new folder under the shared one."""
    return shared_folder(spark, "sink")


def one_line(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


ONE_LINE = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')"
PARSED = CAPTIONS + f" SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, turn) AS pos, start_ms, end_ms, {ONE_LINE} AS text FROM captions WHERE length({ONE_LINE}) > 0"


def _srt(spark, sf_dir):
    c = captions(spark, sf_dir).withColumn("text", one_line("text")).where(F.length("text") > 0)
    return srt.render(c, ["conv_id"], "turn")


@register("A1_parse_srt_timeline", PARSED)
def parse_srt_timeline(spark, sf_dir):
    return srt.parse(_srt(spark, sf_dir), ["conv_id"]).select("conv_id", "pos", "start_ms", "end_ms", "text")


@register("A2_parse_srt_cleaned", CAPTIONS + f""",
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, CASE WHEN turn % 3 = 0 THEN start_ms + 40000 ELSE start_ms END AS start_ms, end_ms + 40000 AS end_ms, {ONE_LINE} AS raw_text FROM captions WHERE length({ONE_LINE}) > 0)
SELECT conv_id, index, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, index) AS pos, start_ms, end_ms, raw_text, trim(regexp_replace(replace(raw_text, 'tion', ''), '[ ]+', ' ', 'g'), ' ') AS text FROM t""")
def parse_srt_cleaned(spark, sf_dir):
    """Captions numbered as they stand and sorted by start, with the raw text and one without fillers."""
    c = captions(spark, sf_dir).withColumn("text", one_line("text")).where(F.length("text") > 0)
    c = c.withColumn("start_ms", F.col("start_ms") + F.when(F.col("turn") % 3 == 0, 40_000).otherwise(0)).withColumn("end_ms", F.col("end_ms") + 40_000)
    p = srt.parse(srt.render(c, ["conv_id"], "turn"), ["conv_id"])
    return p.select("conv_id", F.col("seq_num").alias("index"), "pos", "start_ms", "end_ms", F.col("text").alias("raw_text"), tx.strip_fillers(F.col("text"), ["tion"]).alias("text"))


@register("A3_srt_files", PARSED.replace("SELECT conv_id, row_number()", "SELECT row_number()").replace(f", {ONE_LINE} AS text", ""))
def srt_files(spark, sf_dir):
    """Subtitle files written by one job and read whole by another."""
    out = folder(spark)
    # a file a conversation, in one folder: files are moved by the tasks that write them, and none is found by listing folders one by one
    kept = _srt(spark, sf_dir).select("srt").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    kept.option("lineSep", "\n").text(out)
    files = srt.read_files(spark, f"{out}/*.txt")
    return srt.parse(files, ["path"]).select("pos", "start_ms", "end_ms")


@register("A8_json_steps", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_steps(spark, sf_dir):
    out = folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(out)
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double").json(out)


@register("A10_vad_silences", """
WITH s AS (SELECT user_id AS media_id, event_id, (epoch_us(ts) // 1000) AS start_ms, (epoch_us(ts) // 1000) + CAST(floor(value * 1000) AS BIGINT) AS end_ms FROM events WHERE event_type = 'click'),
g AS (SELECT media_id, coalesce(max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, start_ms AS end_ms FROM s
  UNION ALL SELECT media_id, max(end_ms), max(end_ms) + 90000 FROM s WHERE media_id % 3 > 0 GROUP BY media_id)
SELECT * FROM g WHERE end_ms - start_ms > 500""")
def vad_silences(spark, sf_dir):
    """Speech segments of a medium from JSON under either name of the list and of a bound, at the first of three places
    that exists; the silences between them, and after the last where the total is known."""
    out = folder(spark)
    e = from_events(spark, sf_dir).where("event_type = 'click'")
    part = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("start_ms")).alias("start"), F.when(F.col("event_id") % 2 == 1, F.col("start_ms")).alias("start_sec"), F.col("end_ms").alias("end"))
    g = e.groupBy("media_id").agg(F.collect_list(part).alias("s"), F.when(F.col("media_id") % 3 > 0, F.max("end_ms") + 90_000).alias("total"))  # what one file holds
    odd = F.col("media_id") % 2 == 1
    g.select("media_id", "total", F.when(odd, F.col("s")).alias("speech_segments"), F.when(~odd, F.col("s")).alias("segments")).write.json(f"{out}/second")
    kind = "array<struct<start: bigint, start_sec: bigint, end: bigint>>"
    found = files.first_existing(spark, [f"{out}/{k}" for k in ("first", "second", "third")], "json", f"media_id long, total long, speech_segments {kind}, segments {kind}")
    s = found.select("media_id", F.coalesce("total", F.lit(0)).alias("total"), F.explode(F.coalesce("speech_segments", "segments")).alias("s"))
    s = s.select("media_id", "total", F.coalesce("s.start", "s.start_sec").alias("start_ms"), F.col("s.end").alias("end_ms"))
    return intervals.complement(s, ["media_id"], "total", least=500)


@register("A14_silence_log", SEGMENTS + " SELECT media_id, r_start AS start_ms, r_end AS end_ms FROM silences")
def silence_log(spark, sf_dir):
    """Silences rendered as log lines and parsed back."""
    log = silences(spark, sf_dir).select("media_id", F.format_string("[detect] silence_start: %d | silence_end: %d", "r_start", "r_end").alias("line"))
    at = lambda name: F.regexp_extract("line", rf"silence_{name}: (\d+)", 1).cast("long")
    return log.select("media_id", at("start").alias("start_ms"), at("end").alias("end_ms"))


@register("B1_json_writer", "SELECT c_custkey, c_name FROM customer")
def json_writer(spark, sf_dir):
    out = folder(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").write.mode("overwrite").json(out)
    return spark.read.schema("c_custkey long, c_name string").json(out)


_STAMP = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0')"


@register("B3_render_srt", CAPTIONS + f""",
k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {_STAMP.format('start_ms')} || ' --> ' || {_STAMP.format('end_ms')} AS stamp, {ONE_LINE} AS line FROM captions WHERE length({ONE_LINE}) > 0)
SELECT conv_id, string_agg(k || chr(10) || stamp || chr(10) || line, chr(10) || chr(10) ORDER BY k) AS srt FROM k GROUP BY conv_id""")
def render_srt(spark, sf_dir):
    return _srt(spark, sf_dir)


@register("B4_stage_checkpoint", "SELECT event_type, count(*) AS n, 'success' AS status, 1 AS failures, 2 AS built FROM events GROUP BY event_type")
def stage_checkpoint(spark, sf_dir):
    """A stage that fails once, succeeds when tried again and is only read the third time."""
    out, built = folder(spark), []

    def build():
        built.append(1)
        if len(built) == 1:
            raise ValueError("not yet")
        return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))

    for _ in range(3):
        try:
            found = stages.run(spark, out, build)
        except ValueError:
            if not stages.should_retry(spark, out):
                raise
    status, failures = stages.state(spark, out)
    return found.select("event_type", "n", F.lit(status).alias("status"), F.lit(failures).alias("failures"), F.lit(len(built)).alias("built"))


def merged_topics_sql(source: str) -> str:
    """CTEs up to ``topics`` over the captions of a CTE."""
    return f""",
n AS (SELECT media_id, event_id, start_ms, end_ms, start_ms // 86400000 AS chunk, event_type AS b, lag(event_type) OVER w AS a, lag(end_ms) OVER w AS pe, lag(start_ms // 86400000) OVER w AS pc, row_number() OVER w AS pos FROM {source} WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, event_id)),
s AS (SELECT *, start_ms - pe AS gap, {TITLE} AS sim, {KEYWORDS} AS shared FROM n),
f AS (SELECT *, coalesce(chunk <> pc AND gap >= -2000 AND gap < 28800000 AND (sim > 0.45 OR (sim > 0.3 AND gap < 10800000) OR contains(a, b) OR contains(b, a) OR gap < 3600000 OR shared > 0.25), false) AS f FROM s),
m AS (SELECT *, f AND (pos - max(CASE WHEN NOT f THEN pos END) OVER (PARTITION BY media_id ORDER BY pos)) % 2 = 1 AS takes FROM f),
p AS (SELECT *, sum(CASE WHEN takes THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY pos) AS pair FROM m),
topics AS (SELECT media_id, arg_min(event_id, pos) AS topic_id, min(start_ms) AS start_ms, arg_max(end_ms, pos) AS end_ms, arg_max(b, (length(b), -pos)) AS outline, count(*) AS n FROM p GROUP BY media_id, pair)"""


def merged_topics(e):
    """Topics on both sides of a chunk's end (days here) that belong together become one, in pairs."""
    e = e.withColumn("chunk", F.floor(F.col("start_ms") / 86_400_000)).withColumnRenamed("event_type", "outline")
    prev = F.lag(F.struct("outline", "chunk", "end_ms")).over(Window.partitionBy("media_id").orderBy("start_ms", "event_id"))
    e = e.withColumn("prev", prev)
    flag = topics.belongs_to_previous(F.col("prev.outline"), F.col("outline"), F.col("chunk") != F.col("prev.chunk"), F.col("start_ms") - F.col("prev.end_ms"), STOP, 28_800_000, 10_800_000, 3_600_000)
    p = topics.merge_flagged_pairs(e.withColumn("near", flag), ["media_id"], ["start_ms", "event_id"], F.col("near"))
    order = F.struct("start_ms", "event_id")
    longest = F.max_by("outline", F.struct(F.length("outline"), -F.col("start_ms"), -F.col("event_id")))
    return p.groupBy("media_id", "pair").agg(F.min_by("event_id", order).alias("topic_id"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"), longest.alias("outline"), F.count("*").alias("n")).drop("pair")


@register("F12_merge_neighbour_pairs", EVENTS + merged_topics_sql("captions") + " SELECT * FROM topics")
def merge_neighbour_pairs(spark, sf_dir):
    return merged_topics(from_events(spark, sf_dir))


@register("F16_suppress_overlaps", EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
o AS (SELECT media_id, event_id, event_id % 7 AS score, start_ms AS s, end_ms + 3600000 AS e, row_number() OVER (PARTITION BY media_id ORDER BY event_id % 7 DESC, end_ms - start_ms, event_id) AS rn FROM captions),
r(media_id, rn, kept) AS (SELECT media_id, rn, [{'id': event_id, 's': s, 'e': e}] FROM o WHERE rn = 1
  UNION ALL SELECT o.media_id, o.rn, CASE WHEN len(list_filter(kept, lambda k: least(k.e, o.e) > greatest(k.s, o.s) AND least(k.e, o.e) - greatest(k.s, o.s) > 0.3 * (k.e - k.s + o.e - o.s - (least(k.e, o.e) - greatest(k.s, o.s))))) = 0
    THEN list_append(kept, {'id': o.event_id, 's': o.s, 'e': o.e}) ELSE kept END FROM r JOIN o ON o.media_id = r.media_id AND o.rn = r.rn + 1)
SELECT media_id, k.id AS event_id, k.id % 7 AS score FROM (SELECT media_id, unnest(arg_max(kept, rn)) AS k FROM r GROUP BY media_id)""")
def suppress_overlaps(spark, sf_dir):
    checkpoints(spark)
    e = from_events(spark, sf_dir).withColumn("score", F.col("event_id") % 7)
    # clips that last an hour around each event overlap often
    e = e.withColumn("end_ms", F.col("end_ms") + 3_600_000)
    return topics.suppress(e, ["media_id"], "event_id", "score", 3_600_000, 0.3).select("media_id", "event_id", "score")


@register("F17_align_neighbours", EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
c AS (SELECT media_id, event_id, start_ms AS os, end_ms + (event_id % 4) * 400000 AS oe, (event_id % 5) * 300000 AS m FROM captions),
a AS (SELECT media_id, event_id, os, oe, os - m AS s, oe + m AS e, row_number() OVER (PARTITION BY media_id ORDER BY os - m, event_id) AS rn FROM c),
r(media_id, rn, event_id, os, oe, s, e, a, b) AS (SELECT media_id, rn, event_id, os, oe, s, e, NULL::BIGINT, NULL::BIGINT FROM a WHERE rn = 1
  UNION ALL SELECT media_id, rn, event_id, os, oe, CASE WHEN ns < ce THEN CASE WHEN least(ce, poe) <= greatest(ns, os) THEN greatest(ns, os) ELSE (ce + ns) // 2 END + 50 WHEN poe < os AND s < os THEN os + 50 ELSE s END, e, pid,
    CASE WHEN ns < ce THEN CASE WHEN least(ce, poe) <= greatest(ns, os) THEN greatest(least(ce, poe) - 50, 0) ELSE (ce + ns) // 2 - 50 END WHEN poe < os AND pe > poe THEN greatest(poe - 50, 0) ELSE pe END
  FROM (SELECT a.*, r.event_id AS pid, r.oe AS poe, r.e AS pe, CASE WHEN r.oe < a.os AND r.e > r.oe THEN r.oe ELSE r.e END AS ce, CASE WHEN r.oe < a.os AND a.s < a.os THEN a.os ELSE a.s END AS ns FROM r JOIN a ON a.media_id = r.media_id AND a.rn = r.rn + 1))
SELECT r.media_id, r.event_id, r.s AS a, coalesce(n.b, r.e) AS b FROM r LEFT JOIN r n ON n.media_id = r.media_id AND n.a = r.event_id""")
def align_neighbours(spark, sf_dir):
    c = from_events(spark, sf_dir).select("media_id", "event_id", F.col("start_ms").alias("original_start"), (F.col("end_ms") + F.col("event_id") % 4 * 400_000).alias("original_end"), (F.col("event_id") % 5 * 300_000).alias("m"))
    c = c.withColumn("start_ms", F.col("original_start") - F.col("m")).withColumn("end_ms", F.col("original_end") + F.col("m"))
    out = intervals.separate_aligned(c, ["media_id"], ["start_ms", "event_id"])
    return out.select("media_id", "event_id", F.col("fixed_start").alias("a"), F.col("fixed_end").alias("b"))


@register("F35_clip_completeness", SEGMENTS + """,
g AS (SELECT media_id, segment_id, l_start, l_end + 7200000 AS l_end FROM segments),
p AS (SELECT segment_id, event_type, r_start, r_end, event_id, r_start >= l_start AND r_end <= l_end AS inside, l_start, l_end FROM g JOIN others USING (media_id) WHERE r_start < l_end AND r_end > l_start),
f AS (SELECT segment_id, arg_min(event_type, (CASE WHEN inside THEN 0 ELSE 1 END, r_start, event_id)) AS intro, arg_max(event_type, (CASE WHEN inside THEN 1 ELSE 0 END, r_start, event_id)) AS outro,
  count(*) AS n, count(*) FILTER (inside) AS n_inside FROM p GROUP BY segment_id),
c AS (SELECT segment_id, coalesce(intro <> 'click', false) AS intro_complete, coalesce(outro = 'error', false) AS outro_complete, segment_id % 9 = 0 AS filled, coalesce(round(n_inside / n, 4), 0.0) AS coverage FROM g LEFT JOIN f USING (segment_id))
SELECT segment_id, coverage, intro_complete, outro_complete, list_filter([CASE WHEN NOT intro_complete THEN 'intro_incomplete' END, CASE WHEN NOT outro_complete THEN 'outro_incomplete' END, CASE WHEN filled THEN 'has_gap_fill' END], lambda x: x IS NOT NULL) AS warnings,
  NOT (intro_complete AND outro_complete AND NOT filled) AS needs_review FROM c""")
def clip_completeness(spark, sf_dir):
    """Whether a clip's first caption depends on nothing before and its last ends a sentence; the share of its captions
    that lie wholly inside, and what is to be reviewed."""
    left = segments(spark, sf_dir).withColumn("l_end", F.col("l_end") + 7_200_000)
    pairs = joins.overlap_join(left, others(spark, sf_dir), ["media_id"], 12 * BIN, longest=12 * BIN).withColumn("inside", (F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end")))
    order, inside = [F.col("r_start"), F.col("event_id")], F.col("inside")
    first, last = (joins.first_or_last(pairs, ["segment_id"], F.col("event_type"), order, inside, last=x).withColumnRenamed("value", n) for x, n in ((False, "intro"), (True, "outro")))
    share = pairs.groupBy("segment_id").agg(F.round(F.count_if("inside") / F.count("*"), 4).alias("coverage"))
    out = left.select("segment_id").join(first, "segment_id", "left").join(last, "segment_id", "left").join(share, "segment_id", "left")
    out = out.select("segment_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce(F.col("intro") != "click", F.lit(False)).alias("intro_complete"), F.coalesce(F.col("outro") == "error", F.lit(False)).alias("outro_complete"))
    warn = lambda bad, name: F.when(bad, F.lit(name))
    warnings = F.array_compact(F.array(warn(~F.col("intro_complete"), "intro_incomplete"), warn(~F.col("outro_complete"), "outro_incomplete"), warn(F.col("segment_id") % 9 == 0, "has_gap_fill")))
    return out.withColumn("warnings", warnings).withColumn("needs_review", F.size("warnings") > 0)


@register("J18_captions_in_range", SEGMENTS + " SELECT segment_id, count(event_id) AS n FROM segments LEFT JOIN others ON others.media_id = segments.media_id AND r_start < l_end + 1800000 AND r_end > l_start - 1800000 GROUP BY segment_id")
def captions_in_range(spark, sf_dir):
    left = segments(spark, sf_dir)
    n = joins.overlap_join(left, others(spark, sf_dir), ["media_id"], 6 * BIN, margin=1_800_000, longest=6 * BIN).groupBy("segment_id").agg(F.count("*").alias("n"))
    return left.select("segment_id").join(n, "segment_id", "left").select("segment_id", F.coalesce("n", F.lit(0)).alias("n"))


@register("J19_text_in_range", SEGMENTS + """
SELECT segment_id, string_agg(event_type, '' ORDER BY r_start, event_id) AS text FROM segments JOIN others USING (media_id) WHERE r_start <= l_end + 600000 AND r_end >= l_start - 600000 GROUP BY segment_id""")
def text_in_range(spark, sf_dir):
    p = joins.overlap_join(segments(spark, sf_dir), others(spark, sf_dir), ["media_id"], 2 * BIN, closed=True, margin=600_000, longest=2 * BIN)
    rows = F.array_sort(F.collect_list(F.struct("r_start", "event_id", "event_type")))
    return p.groupBy("segment_id").agg(F.array_join(F.transform(rows, lambda x: x["event_type"]), "").alias("text"))


@register("J26_voice_in_clip", SEGMENTS + """,
s AS (SELECT media_id, segment_id, greatest(l_start, r_start) AS start_ms, least(l_end, r_end) AS end_ms FROM segments JOIN others USING (media_id) WHERE r_start < l_end AND r_end > l_start),
m AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY segment_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 800 THEN 0 ELSE 1 END AS f FROM s),
n AS (SELECT *, sum(f) OVER (PARTITION BY segment_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT segment_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_segments FROM n GROUP BY segment_id, i""")
def voice_in_clip(spark, sf_dir):
    p = joins.overlap_join(segments(spark, sf_dir), others(spark, sf_dir), ["media_id"], BIN, longest=BIN)
    return intervals.merge(p.select("segment_id", F.greatest("l_start", "r_start").alias("start_ms"), F.least("l_end", "r_end").alias("end_ms")), ["segment_id"], 800)


@register("J28_chunk_hotwords", CAPTIONS + f""",
h AS (SELECT unnest({WORDS.format('text')}) AS term, conv_id, start_ms FROM captions), c AS (SELECT term FROM h GROUP BY term HAVING count(*) >= 20),
k AS (SELECT conv_id, chunk, chunk * 5000 AS lo, chunk * 5000 + 6000 AS hi FROM (SELECT conv_id, unnest(range(0, max(start_ms)::BIGINT // 5000 + 1)) AS chunk FROM captions GROUP BY conv_id))
SELECT DISTINCT conv_id, chunk, term FROM h JOIN c USING (term) JOIN k USING (conv_id) WHERE start_ms BETWEEN lo AND hi""")
def chunk_hotwords(spark, sf_dir):
    """Hotwords with a position within a chunk: chunks of 6 s that begin every 5 s, both ends counting."""
    words = captions(spark, sf_dir).select("conv_id", "start_ms", F.explode(tx.words(F.col("text"))).alias("term")).distinct()
    count = captions(spark, sf_dir).select(F.explode(tx.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n >= 20").select("term")
    first = F.greatest(F.lit(0), F.ceil((F.col("start_ms") - 6000) / 5000))
    at = words.join(count, "term").withColumn("chunk", F.explode(F.sequence(first, F.floor(F.col("start_ms") / 5000))))
    last = captions(spark, sf_dir).groupBy("conv_id").agg(F.floor(F.max("start_ms") / 5000).alias("last"))
    return at.join(last, "conv_id").where("chunk <= last").select("conv_id", "chunk", "term").distinct()


@register("J34_id_consistency", "SELECT event_id, 'new-' || event_id AS new_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders)")
def id_consistency(spark, sf_dir):
    missing = rel.orphans(table(spark, sf_dir, "events").select("event_id"), table(spark, sf_dir, "orders"), "event_id", "o_orderkey")
    return missing.select("event_id", F.concat(F.lit("new-"), F.col("event_id").cast("string")).alias("new_id"))


@register("G12_hotword_union", f"""
WITH a AS (SELECT term, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS term FROM conversations) WHERE length(term) >= 2 AND NOT list_contains({STOP_SQL}, term) GROUP BY term HAVING count(*) >= 3),
t AS (SELECT term FROM (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS k FROM a) WHERE k <= 50)
SELECT term FROM (SELECT term, row_number() OVER (ORDER BY stored DESC, term) AS k FROM (SELECT term, max(stored) AS stored FROM (SELECT term, 0 AS stored FROM t UNION ALL SELECT DISTINCT lower(p_type), 1 FROM part) GROUP BY term)) WHERE k <= 200""")
def hotword_union(spark, sf_dir):
    """The 50 most frequent words, joined with the stored list; that goes first, and 200 stay in all."""
    every = F.filter(tx.words(F.col("text")), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP))
    a = mining.term_counts(table(spark, sf_dir, "conversations"), [], every, 3).orderBy(F.desc("n"), "term").limit(50).select("term", F.lit(0).alias("stored"))
    both = a.union(table(spark, sf_dir, "part").select(F.lower("p_type").alias("term"), F.lit(1).alias("stored"))).groupBy("term").agg(F.max("stored").alias("stored"))
    return both.orderBy(F.desc("stored"), "term").limit(200).select("term")


INNER = CLUSTERS + """,
s AS (SELECT root, sum(x) AS s FROM (SELECT root, similarity * n_a * n_b AS x FROM e JOIN rr ON rr.rep = e.a UNION ALL SELECT root, reps.n * (reps.n - 1) / 2 FROM reps JOIN rr USING (rep)) GROUP BY root),
z AS (SELECT DISTINCT root, n FROM cl WHERE n > 1), i AS (SELECT root, n, s / (n * (n - 1) / 2) AS mean FROM z JOIN s USING (root))"""


@register("G14_internal_similarity", INNER + " SELECT root, n, round(mean, 4) AS mean FROM i")
def internal_similarity(spark, sf_dir):
    return mining.inner_similarity(*_clusters(spark, sf_dir)).select("root", "n", F.round("mean", 4).alias("mean"))


@register("G23_batch_outcome", "SELECT c_nationkey, count(*) FILTER (c_acctbal >= 0) AS n_ok, count(*) FILTER (c_acctbal < 0) AS n_failed, list(c_custkey ORDER BY c_custkey) FILTER (c_acctbal < -900) AS failed FROM customer GROUP BY c_nationkey HAVING count(*) FILTER (c_acctbal < -900) > 0")
def batch_outcome(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") >= 0).alias("n_ok"), F.count_if(F.col("c_acctbal") < 0).alias("n_failed"), F.array_sort(F.collect_list(F.when(F.col("c_acctbal") < -900, F.col("c_custkey")))).alias("failed"))
    return g.where(F.size("failed") > 0)


@register("G26_distinct_reasons", "SELECT user_id, count(DISTINCT event_type) AS n, count(DISTINCT event_type) <= 2 AS suspicious FROM events GROUP BY user_id")
def distinct_reasons(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).withColumn("suspicious", F.col("n") <= 2)


@register("H6_semantic_similarity")
def semantic_similarity(spark, sf_dir):
    from spanlake.functions.matching import sequence_ratio

    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = p.select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(w).alias("b")).where("b is not null")
    ratio = F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b"))
    shared = tx.jaccard(tx.keywords(F.col("a"), []), tx.keywords(F.col("b"), []))
    return p.select("p_partkey", F.round(0.4 * shared + 0.3 * sequence_ratio("a", "b") + 0.3 * ratio, 4).alias("similarity"))


@register("H7_sequence_matcher")
def sequence_matcher(spark, sf_dir):
    from spanlake.functions.matching import sequence_ratio

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lead("p_name").over(w).alias("b")).where("b is not null")
    return p.select("p_partkey", F.round(sequence_ratio("p_name", "b"), 6).alias("ratio"))


GENERIC = ("green", "blue", "red")
OUTLINE = """greatest(0.0, least(1.0, 0.5 + CASE WHEN p_size > 40 THEN 0.25 ELSE 0 END + least(0.08 * (p_size % 6), 0.24)
  + CASE WHEN length(p_name) BETWEEN 6 AND 20 THEN 0.15 WHEN length(p_name) < 4 THEN -0.2 ELSE 0 END
  + CASE WHEN regexp_matches(p_name, 'green|blue|red') THEN -0.25 ELSE 0 END + CASE WHEN len(list_distinct(string_split(p_name, ''))) >= 4 THEN 0.05 ELSE 0 END))"""


def _quality():
    return topics.outline_score(F.col("p_name"), F.col("p_size") % 6, F.col("p_size") > 40, GENERIC)


@register("H19_outline_score", f"SELECT p_partkey, round({OUTLINE}, 4) AS score FROM part")
def outline_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(_quality(), 4).alias("score"))


@register("H20_topic_score", f"""
WITH d AS (SELECT p_partkey, {OUTLINE} AS q, (p_size - 1) * 20.0 AS s, p_partkey % 4 / 4.0 AS m FROM part),
f AS (SELECT *, CASE WHEN s <= 0 THEN 0 WHEN s < 120 THEN s / 120 * 0.4 WHEN s > 720 THEN 0.6 ELSE 0.5 + 0.5 * (1 - abs(s - 420) / 600) END AS fit FROM d)
SELECT p_partkey, round(greatest(0.0, least(1.0, CASE WHEN m > 0 THEN q * 0.25 + fit * 0.45 + m * 0.3 ELSE q * 0.35 + fit * 0.65 END)), 6) AS score FROM f""")
def topic_score(spark, sf_dir):
    score = topics.topic_score(_quality(), (F.col("p_size") - 1) * 20.0, F.col("p_partkey") % 4 / 4.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@register("H24_truncate_lines", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, len(l) AS n, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
k AS (SELECT *, i <= 3 OR i > n - 2 OR abs(i - (doc_id % 50)) <= 1 OR abs(i - (doc_id % 80 + 10)) <= 1 AS keep FROM p),
g AS (SELECT *, i - lag(i, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) > 1 AS jump FROM k WHERE keep)
SELECT doc_id, string_agg(CASE WHEN jump THEN '[...]' || chr(10) ELSE '' END || line, chr(10) ORDER BY i) AS kept FROM g GROUP BY doc_id""")
def truncate_lines(spark, sf_dir):
    """The first three and the last two lines of a text and those next to each boundary, with a mark where lines are left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l")).withColumn("n", F.size("l"))
    near = F.array(F.col("doc_id") % 50, F.col("doc_id") % 80 + 10)
    d = d.withColumn("near", near).select("doc_id", "n", "near", F.posexplode("l").alias("i", "line")).withColumn("i", F.col("i") + 1)
    d = d.where((F.col("i") <= 3) | (F.col("i") > F.col("n") - 2) | F.exists("near", lambda b: F.abs(F.col("i") - b) <= 1))
    jump = F.col("i") - F.lag("i", 1, 0).over(Window.partitionBy("doc_id").orderBy("i")) > 1
    d = d.withColumn("line", F.when(jump, F.concat(F.lit("[...]\n"), "line")).otherwise(F.col("line")))
    rows = F.array_sort(F.collect_list(F.struct("i", "line")))  # the lines of one text
    return d.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("kept"))


@register("H30_word_positions", "SELECT p_brand, list(p_partkey ORDER BY p_partkey) AS positions FROM part WHERE contains(p_name, 'a') GROUP BY p_brand")
def word_positions(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.contains("p_name", F.lit("a"))).groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("positions"))


@register("K4_global_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id FROM events")
def global_order(spark, sf_dir):
    return rel.ranked(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "id").select("event_id", "id")


@register("K6_hotword_order", f"SELECT term, n FROM (SELECT term, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY term) ORDER BY term = 'the' DESC, n DESC, term LIMIT 20")
def hotword_order(spark, sf_dir):
    n = mining.term_counts(table(spark, sf_dir, "documents"), [], tx.words(F.col("text")))
    return n.orderBy(F.desc(F.col("term") == "the"), F.desc("n"), "term").limit(20)


@register("K7_cap_per_collection", "SELECT c_nationkey, list(c_custkey ORDER BY c_custkey)[1:5] AS clip_ids FROM customer GROUP BY c_nationkey")
def cap_per_collection(spark, sf_dir):
    c = rel.top(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], [F.col("c_custkey")], 5)
    return c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("clip_ids"))


@register("K14_retention", "SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAYS")
def retention(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderdate") < o.agg(F.max("o_orderdate")).scalar() - F.expr("INTERVAL 30 DAYS")).select("o_orderkey")


@register("U2_sync_sets", """
WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS now FROM events GROUP BY user_id)
SELECT user_id, len(list_filter(now, lambda x: x NOT IN ('view', 'click'))) AS n_add, 2 - len(list_intersect(now, ['view', 'click'])) AS n_remove, len(list_intersect(now, ['view', 'click'])) AS n_same FROM a""")
def sync_sets(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("now"))
    old = F.array(F.lit("view"), F.lit("click"))
    n = lambda c: F.size(c).cast("long")
    return a.select("user_id", n(F.array_except("now", old)).alias("n_add"), n(F.array_except(old, "now")).alias("n_remove"), n(F.array_intersect("now", old)).alias("n_same"))


@register("U3_distinct_in_order", f"WITH g AS (SELECT doc_id, {WORDS.format('text')} AS l FROM documents), u AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM g) GROUP BY doc_id, w) SELECT doc_id, coalesce(words, []) AS words FROM documents LEFT JOIN (SELECT doc_id, list(w ORDER BY i) AS words FROM u GROUP BY doc_id) USING (doc_id)")
def distinct_in_order(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(tx.words(F.col("text"))).alias("words"))


@register("U5_append_if_absent", """
WITH s AS (SELECT user_id, event_type AS a, event_id % 4 AS b, event_id FROM events WHERE event_type = 'view'), n AS (SELECT user_id, event_type AS a, event_id % 4 AS b, event_id FROM events WHERE event_type IN ('view', 'click')),
m AS (SELECT user_id, a, b, min(event_id) AS event_id FROM n GROUP BY ALL)
SELECT user_id, a, b, event_id FROM s UNION ALL SELECT user_id, a, b, event_id FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = m.user_id AND s.a = m.a AND s.b = m.b)""")
def append_if_absent(spark, sf_dir):
    """Stored sections as they are, and of the new ones those whose key (two bounds) isn't stored, each once."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("a"), (F.col("event_id") % 4).alias("b"), "event_id")
    stored, by = e.where("a = 'view'"), ["user_id", "a", "b"]
    new = e.where("a in ('view', 'click')").groupBy(*by).agg(F.min("event_id").alias("event_id"))
    return stored.unionByName(new.join(stored, by, "left_anti"))


_KEY = "'clip_' || left(sha256(event_type || chr(31) || user_id), 16)"


def _surrogate(source, ident):
    return F.concat(F.lit("clip_"), F.left(F.sha2(F.concat_ws("\x1f", source, ident.cast("string")), 256), F.lit(16)))


@register("X4_surrogate_keys", f"SELECT event_type, user_id, {_KEY} AS global_id FROM (SELECT DISTINCT event_type, user_id FROM events)")
def surrogate_keys(spark, sf_dir):
    """A key table in two runs: the second adds only pairs that the first has not, so a pair keeps its key for ever."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id")
    keyed = lambda df: df.distinct().withColumn("global_id", _surrogate(F.col("event_type"), F.col("user_id")))
    out = folder(spark)
    keyed(e.where("user_id % 2 = 0")).write.parquet(out)
    old = spark.read.parquet(out)
    keyed(e.join(old, ["event_type", "user_id"], "left_anti")).write.mode("append").parquet(out)
    return spark.read.schema(old.schema).parquet(out)


@register("X5_validated_ids", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_orderkey % 1000 || '-' || l_linenumber END AS id FROM lineitem),
f AS (SELECT *, coalesce(id, 'clip_' || left(sha256('step2' || chr(31) || l_orderkey), 16)) AS filled FROM t)
SELECT l_orderkey, l_linenumber, filled AS id, id IS NULL AS was_missing, count(*) OVER (PARTITION BY filled) > 1 AND id IS NOT NULL AS repeated FROM f""")
def validated_ids(spark, sf_dir):
    """Rows without an id get a stable one; ids that several rows have are flagged."""
    ident = F.when(F.col("l_linenumber") != 3, F.concat_ws("-", (F.col("l_orderkey") % 1000).cast("string"), F.col("l_linenumber").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ident.alias("id"))
    rows = rows.withColumn("was_missing", F.col("id").isNull()).withColumn("id", F.coalesce("id", _surrogate(F.lit("step2"), F.col("l_orderkey"))))
    often = rows.where("not was_missing").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("repeated"))
    return rows.join(often, "id", "left").select("l_orderkey", "l_linenumber", "id", "was_missing", (F.coalesce("repeated", F.lit(False)) & ~F.col("was_missing")).alias("repeated"))


@register("X5_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@register("X10_mode_by_size", EVENTS + " SELECT media_id, CASE WHEN count(*) > 60 OR max(end_ms) - min(start_ms) > 2500000000 THEN 'three_step' ELSE 'merged' END AS mode FROM captions GROUP BY media_id")
def mode_by_size(spark, sf_dir):
    g = from_events(spark, sf_dir).groupBy("media_id").agg(F.count("*").alias("n"), (F.max("end_ms") - F.min("start_ms")).alias("span"))
    return g.select("media_id", F.when((F.col("n") > 60) | (F.col("span") > 2_500_000_000), "three_step").otherwise("merged").alias("mode"))


@register("X12_short_segment_policy", EVENTS + """
SELECT event_id, CASE WHEN end_ms - start_ms >= 30000 OR c >= 60 OR s >= 65 THEN 'keep' WHEN c >= 40 OR (c IS NULL AND s >= 40) THEN 'ask' ELSE 'review' END AS verdict
FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN event_id % 100 END AS c, event_id * 7 % 90 AS s FROM captions)""")
def short_segment_policy(spark, sf_dir):
    """Long segments stay; short ones by their confidence or the topic's score, those in between are asked about."""
    c, s = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 100), F.col("event_id") * 7 % 90
    v = F.when((F.col("end_ms") - F.col("start_ms") >= 30_000) | (c >= 60) | (s >= 65), "keep").when((c >= 40) | (c.isNull() & (s >= 40)), "ask").otherwise("review")
    return from_events(spark, sf_dir).select("event_id", v.alias("verdict"))


@register("X13_duration_flags", EVENTS + """,
f AS (SELECT media_id, event_id, start_ms, CASE WHEN end_ms - start_ms < 10000 THEN 'too_short' WHEN end_ms - start_ms > 200000 THEN 'too_long' ELSE 'ok' END AS flag,
  CASE WHEN event_type = 'click' AND end_ms - start_ms > 100000 THEN 'daily' ELSE event_type END AS kind, event_id % 17 AS score FROM captions),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, event_id) AS k FROM f)
SELECT media_id, event_id, flag, kind, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, event_id) AS pos FROM r WHERE k <= 8""")
def duration_flags(spark, sf_dir):
    """Flags by duration, a product type (click here) cleared from long topics, and the best eight of a medium in order."""
    f = topics.duration_flags(from_events(spark, sf_dir), 10_000, 200_000)
    kind = F.when((F.col("event_type") == "click") & (F.col("end_ms") - F.col("start_ms") > 100_000), "daily").otherwise(F.col("event_type"))
    best = rel.top(f.withColumn("kind", kind).withColumn("score", F.col("event_id") % 17), ["media_id"], [F.desc("score"), F.col("event_id")], 8)
    return rel.ranked(best, ["media_id"], [F.col("start_ms"), F.col("event_id")], "pos").select("media_id", "event_id", "flag", "kind", "pos")


@register("Y6_outline_lines", f"""
WITH t AS (SELECT conv_id, turn, {ONE_LINE} AS line, role = 'user' AS head FROM conversations), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM t)
SELECT conv_id, grp::BIGINT AS pos, max(line) FILTER (head) AS title, coalesce(list(line ORDER BY turn) FILTER (NOT head), []) AS items FROM g WHERE grp > 0 GROUP BY conv_id, grp""")
def outline_lines(spark, sf_dir):
    """Turns rendered as a numbered outline, and parsed into heads with the items that follow each."""
    line = F.when(F.col("role") == "user", F.concat((F.col("turn") + 1).cast("string"), F.lit(". **"), one_line("text"), F.lit("**"))).otherwise(F.concat(F.lit("- "), one_line("text")))
    doc = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    lines = doc.select("conv_id", F.posexplode(F.transform("l", lambda x: x["line"])).alias("at", "line"))
    title = F.nullif(F.regexp_extract("line", r"^\d+\. \*\*(.*)\*\*$", 1), F.lit(""))
    lines = lines.withColumn("title", title).withColumn("pos", F.count("title").over(Window.partitionBy("conv_id").orderBy("at")))
    item = F.when(F.col("title").isNull() & F.startswith("line", F.lit("- ")), F.struct("at", F.substr("line", F.lit(3)).alias("t")))
    return lines.where("pos > 0").groupBy("conv_id", "pos").agg(F.max("title").alias("title"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("items"))


@register("Y9_map_merge", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '9' ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def map_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("9"))).otherwise(F.create_map(F.lit("j"), F.lit("1")))
    kept = F.map_filter("m", lambda k, v: ~F.map_contains_key(right, k))
    return e.select("event_id", F.map_concat(kept, right)["k"].alias("k"))
