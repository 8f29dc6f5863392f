"""Queries over texts, times and JSON columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanlake.functions import text as tx
from spanlake.functions import times
from spanlake.functions.unicode import normalised
from spanlake.operators import mining
from spanlake.plans.catalogue import register
from spanlake.plans.relational_queries import table
from spanlake.storage import checkpoints

STOP = ("the", "and", "of", "to", "der", "die", "und", "el", "la", "de", "le", "les")
WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 0)"
STOP_SQL = "[" + ", ".join(f"'{s}'" for s in STOP) + "]"


def captions(spark, sf_dir):
    """Turns as captions: a turn lasts ten milliseconds per character, one after another."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") * 10).over(w), F.lit(0)).cast("long")
    return c.select("conv_id", "turn", "role", "text", start.alias("start_ms"), (start + F.length("text") * 10).alias("end_ms"))


CAPTIONS = """
WITH captions AS (SELECT conv_id, turn, role, text, CAST(coalesce(sum(length(text) * 10) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
  CAST(coalesce(sum(length(text) * 10) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(text) * 10 AS end_ms FROM conversations)"""
SRT = "lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0')"


@register("T1_parse_round_trip", CAPTIONS + " SELECT conv_id, turn, start_ms AS ms FROM captions")
def parse_round_trip(spark, sf_dir):
    return captions(spark, sf_dir).select("conv_id", "turn", times.parse_ms(times.format_ms(F.col("start_ms"))).alias("ms"))


@register("T2_lenient_times", "SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS ms FROM events")
def lenient_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.parse_ms(F.format_string("%.3f", "value"), "lenient").alias("ms"))


@register("T3_format_srt", CAPTIONS + f" SELECT conv_id, turn, {SRT.format('end_ms')} || ',' || lpad(CAST(end_ms % 1000 AS VARCHAR), 3, '0') AS stamp FROM captions")
def format_srt(spark, sf_dir):
    return captions(spark, sf_dir).select("conv_id", "turn", times.format_ms(F.col("end_ms")).alias("stamp"))


@register("T4_format_plain", CAPTIONS + f" SELECT conv_id, turn, {SRT.format('end_ms')} AS stamp, {SRT.format('end_ms')} || '.' || lpad(CAST(end_ms % 1000 AS VARCHAR), 3, '0') AS dotted FROM captions")
def format_plain(spark, sf_dir):
    return captions(spark, sf_dir).select("conv_id", "turn", times.format_ms(F.col("end_ms"), "plain").alias("stamp"), times.format_ms(F.col("end_ms"), "dotted").alias("dotted"))


@register("T5_time_range", CAPTIONS + f" SELECT conv_id, turn, {SRT.format('start_ms')} || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') || ' - ' || {SRT.format('end_ms')} || '.' || lpad(CAST(end_ms % 1000 AS VARCHAR), 3, '0') AS span FROM captions")
def time_range(spark, sf_dir):
    return captions(spark, sf_dir).select("conv_id", "turn", times.time_range(F.col("start_ms"), F.col("end_ms")).alias("span"))


@register("T6_durations", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR e < o_orderdate THEN NULL ELSE round((epoch_us(e) - epoch_us(o_orderdate)) / 86400000000.0, 1) END AS days FROM (
  SELECT o_orderkey, o_orderdate, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN l ELSE (SELECT max(o_orderdate) FROM orders) END AS e FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""")
def durations(spark, sf_dir):
    """Days from start to end: the end depends on the status; unstarted and negative ones have none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    end = F.when(F.col("o_orderstatus") == "F", F.col("shipped")).otherwise(o.agg(F.max("o_orderdate")).scalar())
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    days = F.when((F.col("o_orderstatus") != "P") & (micros >= 0), F.round(micros / 86_400_000_000, 1))
    return o.join(shipped, "o_orderkey", "left").select("o_orderkey", days.alias("days"))


@register("T10_clamp", CAPTIONS + " SELECT conv_id, turn, CASE WHEN end_ms BETWEEN 1000 AND 16000 THEN end_ms ELSE greatest(6000, least(11000, end_ms)) END AS clamped FROM captions")
def clamp(spark, sf_dir):
    return captions(spark, sf_dir).select("conv_id", "turn", times.clamp(F.col("end_ms"), F.lit(6_000), F.lit(11_000), 5_000).alias("clamped"))


@register("F23_semantic_chunks", CAPTIONS + """,
f AS (SELECT *, CASE WHEN role = lag(role) OVER w AND start_ms - lag(end_ms) OVER w < 800 THEN 0 ELSE 1 END AS fresh FROM captions WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chunk FROM f)
SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, any_value(role) AS role, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY conv_id, chunk""")
def semantic_chunks(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    same = (F.col("role") == F.lag("role").over(w)) & (F.col("start_ms") - F.lag("end_ms").over(w) < 800)
    f = captions(spark, sf_dir).withColumn("fresh", F.when(same, 0).otherwise(1))
    g = f.withColumn("chunk", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("conv_id", "chunk").agg(F.any_value("role").alias("role"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


@register("F31_groups_of_three", "SELECT conv_id, (turn_no - 1) // 3 AS grp, count(*) AS n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations) GROUP BY ALL")
def groups_of_three(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.floor((k - 1) / 3).alias("grp")).groupBy("conv_id", "grp").agg(F.count("*").alias("n"))


@register("F31_best_in_order", """
WITH b AS (SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 20)
SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS grp FROM b""")
def best_in_order(spark, sf_dir):
    """The other variant: the 20 of the highest score, in order of time, by threes."""
    from spanlake.operators import relational as rel

    best = rel.top(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 20)
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return best.select("user_id", "event_id", F.floor((k - 1) / 3).alias("grp"))


@register("F36_align_sentences", """
WITH s AS (SELECT doc_id, length(text) AS total, string_split_regex(text, '[.!?;]') AS l FROM documents), p AS (SELECT doc_id, total, unnest(l) AS sentence, generate_subscripts(l, 1) AS i FROM s),
u AS (SELECT doc_id, i, total, length(sentence) AS n, sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(sentence) - 1 AS before FROM p),
t AS (SELECT doc_id, i, CAST(CASE WHEN total > 0 THEN floor(60000.0 * before / total) ELSE 0 END AS BIGINT) AS a, CAST(CASE WHEN total > 0 THEN floor(60000.0 * (before + n) / total) ELSE 0 END AS BIGINT) AS b FROM u)
SELECT doc_id, i, a AS start_ms, greatest(b, a + 100) AS end_ms FROM t""")
def align_sentences(spark, sf_dir):
    """All sentences of each text: each has its offset's share of the whole text, of 60 s, and lasts 100 ms at least."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("total"), F.posexplode(F.split("text", "[.!?;]")).alias("i", "sentence"))
    before = F.sum(F.length("sentence") + 1).over(Window.partitionBy("doc_id").orderBy("i")) - F.length("sentence") - 1  # with the marks
    at = lambda offset: F.when(F.col("total") > 0, F.floor(60000.0 * offset / F.col("total"))).otherwise(0)
    d = d.withColumn("before", before)
    return d.select("doc_id", (F.col("i") + 1).alias("i"), at(F.col("before")).alias("start_ms"), F.greatest(at(F.col("before") + F.length("sentence")), at(F.col("before")) + 100).alias("end_ms"))


@register("H1_strip_fillers", "SELECT doc_id, trim(regexp_replace(replace(replace(text, 'tion', ''), 'er', ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') AS cleaned FROM documents")
def strip_fillers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_fillers(F.col("text"), ["er", "tion"]).alias("cleaned"))


_NG = "regexp_replace(text, '[\\s,()\\[\\]-]', '', 'g')"


@register("H2_char_ngrams", f"""
WITH t AS (SELECT doc_id, {_NG} AS c, CASE WHEN (SELECT avg(length(text)) FROM documents) > 25 THEN 3 ELSE 2 END AS n FROM documents),
l AS (SELECT doc_id, n, unnest(string_split(c, '')) AS a, generate_subscripts(string_split(c, ''), 1) AS i FROM t WHERE c <> ''),
g AS (SELECT doc_id, n, a || lead(a) OVER w || CASE WHEN n = 3 THEN lead(a, 2) OVER w ELSE '' END AS g FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, list_sort(list(DISTINCT g)) AS grams FROM g WHERE g IS NOT NULL AND length(translate(g, 'eta', '')) > 0 GROUP BY doc_id)
SELECT doc_id, n, coalesce(grams, []) AS grams FROM t LEFT JOIN k USING (doc_id)""")
def char_ngrams(spark, sf_dir):
    """Sets of n-grams of texts in form NFKC; n is 3 if texts have more than 25 characters on average, else 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.when(docs.agg(F.avg(F.length("text"))).scalar() > 25, 3).otherwise(2)
    b = normalised(docs, "text")
    grams = {k: F.sort_array(tx.clean_ngrams(F.col("text"), k, "eta")) for k in (2, 3)}
    return b.withColumn("n", n).select("doc_id", "n", F.when(F.col("n") == 3, grams[3]).otherwise(grams[2]).alias("grams"))


PAIRS = """
WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part), q AS (SELECT * FROM p WHERE b IS NOT NULL)"""


def _pairs(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(w).alias("b")).where("b is not null")


def _grams(c: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({c}) - {n - 2}, 1)), lambda i: substr({c}, i, {n})))"


_SHARED = f"len(list_intersect({_grams('a', 2)}, {_grams('b', 2)}))"


@register("H3_set_cosine", PAIRS + f" SELECT p_partkey, CASE WHEN {_SHARED} < 2 THEN 0.0 ELSE round({_SHARED} / sqrt(CAST(len({_grams('a', 2)}) AS DOUBLE) * len({_grams('b', 2)})), 6) END AS cosine FROM q")
def set_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(tx.set_cosine(tx.char_ngrams(F.col("a"), 2), tx.char_ngrams(F.col("b"), 2), 2), 6).alias("cosine"))


def _words_of(c: str) -> str:
    return f"list_filter(list_distinct({WORDS.format(c)}), lambda w: length(w) >= 2 AND NOT list_contains({STOP_SQL}, w))"


def _jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({_words_of(a)}, {_words_of(b)})) / CAST(len(list_distinct(list_concat({_words_of(a)}, {_words_of(b)}))) AS DOUBLE))"


def _overlap(a: str, b: str) -> str:
    shared = lambda n: f"len(list_intersect({_grams(a, n)}, {_grams(b, n)})) > 0"
    return f"(CASE WHEN {shared(3)} THEN 1.0 WHEN {shared(2)} THEN 2 / 3.0 WHEN {shared(1)} THEN 1 / 3.0 ELSE 0.0 END)"


def title_sql(a: str, b: str) -> str:
    """Similarity of two titles."""
    return f"""(CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.85 WHEN len({_words_of(a)}) = 0 OR len({_words_of(b)}) = 0 THEN 0.0
  ELSE 0.5 * {_jaccard(a, b)} + 0.2 * (least(length({a}), length({b})) / CAST(greatest(length({a}), length({b})) AS DOUBLE)) + 0.3 * {_overlap(a, b)} END)"""


TITLE = title_sql("a", "b")
KEYWORDS = f"(CASE WHEN len(list_concat({_words_of('a')}, {_words_of('b')})) = 0 THEN 0.0 ELSE {_jaccard('a', 'b')} END)"


@register("H4_title_similarity", PAIRS + f" SELECT p_partkey, round({TITLE}, 4) AS similarity FROM q")
def title_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(tx.title_similarity(F.col("a"), F.col("b"), STOP), 4).alias("similarity"))


@register("H5_char_overlap", PAIRS + f" SELECT p_partkey, round({_overlap('a', 'b')}, 4) AS overlap FROM q")
def char_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(tx.char_overlap(F.col("a"), F.col("b")), 4).alias("overlap"))


_WORDY = f"list_filter(list_distinct({WORDS.format('name')}), lambda w: length(w) >= 5 AND NOT list_contains({STOP_SQL}, w))"


@register("H8_keywords", f"""
WITH n AS (SELECT p_partkey, p_name AS name, regexp_replace(lower(p_name), '\\s', '', 'g') AS flat FROM part)
SELECT p_partkey, list_sort(CASE WHEN len({_WORDY}) > 0 THEN {_WORDY} ELSE list_distinct(list_transform(range(1, greatest(length(flat), 1)), lambda i: substr(flat, i, 2))) END) AS keywords FROM n""")
def keywords(spark, sf_dir):
    """Words of five or more characters, or the bigrams of a name without any."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(tx.keywords_or_pairs(F.col("p_name"), STOP, 5)).alias("keywords"))


@register("H12_text_predicates", """
SELECT conv_id, turn, starts_with(trim(text, ' '), 'Th') OR starts_with(trim(text, ' '), 'An') AS continues, right(trim(text, ' '), 1) IN ('.', '!', '?') AS ends,
  starts_with(trim(text, ' '), 'Th') OR starts_with(trim(text, ' '), 'So') AS depends, contains(text, 'tion') OR contains(text, 'ing ') AS switches FROM conversations""")
def text_predicates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.starts_with_any(t, ["Th", "An"]).alias("continues"), tx.ends_sentence(t).alias("ends"), tx.starts_with_any(t, ["Th", "So"]).alias("depends"), tx.contains_any(t, ["tion", "ing "]).alias("switches"))


@register("H13_estimate_tokens", "SELECT doc_id, (length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) * 20 + (length(text) - length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))) * 3) // 10 AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


_N = "length(replace(replace(text, ' ', ''), chr(10), ''))"
LENGTH = f"(CASE WHEN {_N} BETWEEN 20 AND 80 THEN 1.0 WHEN {_N} BETWEEN 10 AND 19 THEN 0.7 + 0.3 * ({_N} - 10) / 10.0 WHEN {_N} BETWEEN 81 AND 120 THEN 0.7 + 0.3 * (120 - {_N}) / 40.0 WHEN {_N} < 10 THEN greatest(0.2, {_N} / 10.0 * 0.5) ELSE greatest(0.2, 120.0 / {_N} * 0.5) END)"
_CLEAN = "regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9]', '', 'g')"
_RATIO = f"(len(list_distinct(string_split({_CLEAN}, ''))) / CAST(length({_CLEAN}) AS DOUBLE))"
DIVERSITY = f"(CASE WHEN length({_CLEAN}) = 0 THEN 0.0 WHEN {_RATIO} >= 0.3 THEN least(1.0, ({_RATIO} - 0.3) / 0.4) ELSE {_RATIO} END)"
ENERGY = "(CASE WHEN {0} BETWEEN 0.3 AND 0.7 THEN 1.0 WHEN {0} < 0.3 THEN greatest(0.2, {0} / 0.3 * 0.7) ELSE greatest(0.2, (1 - {0}) / 0.3 * 0.7) END)"
KEYWORD = "(0.3 + least(0.25, 0.05 * len(regexp_extract_all(text, '(the|und|les)'))))"


@register("H14_length_score", f"SELECT conv_id, turn, round({LENGTH}, 6) AS score FROM conversations UNION ALL SELECT item_id, -1, round({LENGTH}, 6) FROM (SELECT p_partkey AS item_id, p_name AS text FROM part)")
def length_score(spark, sf_dir):
    short = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.col("p_name").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(short)
    return rows.select("conv_id", "turn", F.round(tx.length_score(F.col("text")), 6).alias("score"))


@register("H15_diversity_score", f"SELECT doc_id, round({DIVERSITY}, 6) AS score FROM documents")
def diversity_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.diversity_score(F.col("text")), 6).alias("score"))


@register("H16_keyword_score", f"SELECT doc_id, round({KEYWORD}, 4) AS score FROM documents")
def keyword_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.keyword_score(F.col("text"), "(the|und|les)"), 4).alias("score"))


@register("H22_corrected_lines", """
WITH d AS (SELECT p_partkey, p_type || CASE WHEN p_partkey % 2 = 0 THEN ' tion' ELSE '' END || repeat('!', p_partkey % 60) AS t FROM part),
n AS (SELECT *, replace(t, 'tion', 'zion') AS r FROM d), s AS (SELECT *, regexp_replace(r, '!{3,}', '!', 'g') AS q FROM n)
SELECT p_partkey, CASE WHEN length(q) < 0.55 * length(t) THEN t ELSE q END AS text, CASE WHEN q = t THEN 1.0 WHEN length(q) < 0.55 * length(t) THEN 0.8 WHEN q <> r THEN 0.75 ELSE 0.9 END AS confidence FROM s""")
def corrected_lines(spark, sf_dir):
    t = F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, " tion").otherwise(""), F.repeat(F.lit("!"), (F.col("p_partkey") % 60).cast("int")))
    d = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    return d.select("p_partkey", tx.corrected(F.col("t"), {"tion": "zion"}).alias("c")).select("p_partkey", "c.*")


@register("H28_file_name", """SELECT page_id, regexp_replace(regexp_replace(trim(url, ' '), '[<>:"/\\\\|?*\\x00-\\x1f]', '', 'g'), '[ \\t\\n\\r\\f\\v]+', '_', 'g') AS name FROM pages""")
def file_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.file_name(F.col("url")).alias("name"))


@register("H29_fallback_title", "SELECT doc_id, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS title, left(CASE WHEN doc_id % 3 = 0 THEN lang ELSE text END, 50) AS by_outline FROM documents")
def fallback_title(spark, sf_dir):
    """Both variants: the beginning of the text with dots, and the beginning of the outline, or of the text without one."""
    outline = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.fallback_title(F.lit(None).cast("string"), F.col("text")).alias("title"), F.left(F.coalesce(outline, "text"), F.lit(50)).alias("by_outline"))


@register("G11_term_frequency", f"SELECT term, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY term HAVING count(*) >= 5")
def term_frequency(spark, sf_dir):
    return mining.term_counts(table(spark, sf_dir, "documents"), [], tx.words(F.col("text")), 5)


@register("G13_tf_idf", f"""
WITH w AS (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term), s AS (SELECT doc_id, term, tf, df, round(tf * (ln(((SELECT count(DISTINCT doc_id) FROM t) + 1) / CAST(df + 1 AS DOUBLE)) + 1), 6) AS score FROM t JOIN d USING (term))
SELECT doc_id, term, tf, df, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 3""")
def tf_idf(spark, sf_dir):
    return mining.tf_idf(table(spark, sf_dir, "documents"), "doc_id", tx.words(F.col("text")), 3)


@register("G17_themes", """
WITH s AS (SELECT doc_id, contains(text, 'the')::INT + contains(text, 'ing')::INT AS a, contains(text, 'und')::INT + contains(text, 'ver')::INT AS b, contains(text, 'les')::INT + contains(text, 'eau')::INT AS c FROM documents)
SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'en' WHEN b >= c THEN 'de' ELSE 'fr' END AS theme, greatest(a, b, c) AS n FROM s WHERE greatest(a, b, c) > 0""")
def themes(spark, sf_dir):
    return mining.themes(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), {"en": ["the", "ing"], "de": ["und", "ver"], "fr": ["les", "eau"]})


SIMILAR = f"""
WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS k, list_sort(list_distinct({WORDS.format('text')})) AS g FROM conversations),
m AS (SELECT k, min(k) OVER (PARTITION BY g) AS rep, g FROM t WHERE len(g) > 0), reps AS (SELECT rep, count(*) AS n, any_value(g) AS g FROM m GROUP BY rep),
w AS (SELECT rep AS k, n, len(g) AS size, unnest(g) AS term FROM reps),
c AS (SELECT x.k AS a, y.k AS b, any_value(x.n) AS n_a, any_value(y.n) AS n_b, round(count(*) / sqrt(CAST(any_value(x.size) AS DOUBLE) * any_value(y.size)), 6) AS similarity FROM w x JOIN w y ON x.term = y.term AND x.k < y.k GROUP BY x.k, y.k),
e AS (SELECT * FROM c WHERE similarity >= 0.35)"""
CLUSTERS = SIMILAR + """,
v AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT rep, rep FROM reps UNION SELECT v.b, r.root FROM r JOIN v ON v.a = r.node),
rr AS (SELECT node AS rep, min(root) AS root FROM r GROUP BY node), cl AS (SELECT k AS node, root, count(*) OVER (PARTITION BY root) AS n FROM m JOIN rr USING (rep))"""


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")


def _similar(spark, sf_dir):
    return mining.similar_pairs(_turns(spark, sf_dir), "k", tx.words(F.col("text")), 0.35)


def _linked(spark, sf_dir):
    """Pairs of classes, and classes of turns."""
    return _similar(spark, sf_dir), mining.set_classes(_turns(spark, sf_dir), "k", tx.words(F.col("text")))


def _clusters(spark, sf_dir):
    """Pairs of classes, classes and clusters of turns; the first two are cut off from their lineage."""
    checkpoints(spark)
    pairs, classes = (x.checkpoint() for x in _linked(spark, sf_dir))
    return pairs, classes, mining.similar_clusters(pairs, classes)


@register("J29_similarity_join", SIMILAR + " SELECT a, b, similarity, n_a, n_b FROM e")
def similarity_join(spark, sf_dir):
    return _similar(spark, sf_dir)


@register("J29_set_classes", SIMILAR + " SELECT k, rep FROM m")
def set_classes(spark, sf_dir):
    return mining.set_classes(_turns(spark, sf_dir), "k", tx.words(F.col("text")))


@register("F29_components", CLUSTERS + " SELECT node, root FROM cl WHERE n > 1")
def components(spark, sf_dir):
    return _clusters(spark, sf_dir)[2]


@register("Y1_safe_parse", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def safe_parse(spark, sf_dir):
    """Replies that are JSON, hold it between other words, as an object or in a list, or hold none."""
    from spanlake.functions import json as js

    p, kind = F.col("props"), F.col("event_id") % 5
    reply = F.when(kind == 0, p).when(kind == 1, F.concat(F.lit("It is "), p, F.lit(" as asked."))).when(kind == 2, F.concat(F.lit("[ "), p, F.lit(",] is it"))).when(kind == 3, F.concat(F.lit(" \n"), p)).otherwise("no {json here")
    body = js.body(reply)
    one = F.coalesce(F.from_json(body, "k bigint")["k"], F.get(F.from_json(body, "array<struct<k:bigint>>"), F.lit(0))["k"])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(one, F.lit(-1)).alias("k"))


@register("Y2_step_replies", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def step_replies(spark, sf_dir):
    """Replies as a raw list, fenced, or within words; the list itself, or under a wrapper key; with trailing commas."""
    from spanlake.functions import json as js

    kind = F.col("event_id") % 6
    rows = F.concat(F.lit("["), "props", F.lit(",]"))
    rows = F.when(kind % 2 == 0, rows).otherwise(F.concat(F.lit('{"topics": '), rows, F.lit("}")))
    reply = F.when(kind < 2, rows).when(kind < 4, F.concat(F.lit("Answer:\n```json\n"), rows, F.lit("\n```"))).otherwise(F.concat(F.lit("Here you are: "), rows, F.lit(" - done")))
    return table(spark, sf_dir, "events").select("event_id", F.get(js.listed(reply, "topics", "struct<k:bigint>"), F.lit(0))["k"].alias("k"))


@register("Y7_nested_path", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def nested_path(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@register("Y8_nested_bounds", CAPTIONS + " SELECT conv_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_max(role, turn) AS last_role FROM captions GROUP BY conv_id")
def nested_bounds(spark, sf_dir):
    parts = captions(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "start_ms", "end_ms", "role"))).alias("s"))
    return parts.select("conv_id", F.array_min(F.transform("s", lambda x: x["start_ms"])).alias("start_ms"), F.array_max(F.transform("s", lambda x: x["end_ms"])).alias("end_ms"), F.element_at("s", -1)["role"].alias("last_role"))


@register("Y10_to_json", """SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' AS json FROM orders""")
def to_json(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("json"))


WEIGHTS = {"signup": 10, "view": 15, "click": 20, "purchase": 25, "error": 30}
_S1 = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {sum(list(WEIGHTS.values())[:i])} + {v} * (event_id % 101) / 100.0" for i, (k, v) in enumerate(WEIGHTS.items())) + " END"


WEIGHTS = {"signup": 10, "view": 15, "click": 20, "purchase": 25, "error": 30}
_BEFORE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {sum(list(WEIGHTS.values())[:i])}" for i, k in enumerate(WEIGHTS)) + " END"
_OF = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"


@register("S1_compute_percent", f"""
SELECT event_id, CAST(CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN least(100, {_BEFORE} + {_OF}) WHEN event_id % 4 = 0 THEN least(99, {_BEFORE}) ELSE least(99, floor({_BEFORE} + {_OF} * (event_id % 101) / 100.0)) END AS BIGINT) AS percent FROM events""")
def compute_percent(spark, sf_dir):
    """Every fourth event has no share of its own; the last stage is then done."""
    from spanlake.streaming.progress import percent

    sub = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 101)
    return table(spark, sf_dir, "events").select("event_id", percent(F.col("event_type"), sub, WEIGHTS, "error").alias("percent"))


@register("S2_latest_progress", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, max(ts) AS ts FROM events GROUP BY user_id")
def latest_progress(spark, sf_dir):
    from spanlake.streaming.progress import streamed_latest

    return streamed_latest(spark, f"{sf_dir}/events.parquet", "user_id", ["ts", "event_id"], "event_type").select("user_id", F.col("event_type").alias("stage"), "ts")


@register("S3_snapshots", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY user_id")
def snapshots(spark, sf_dir):
    """Some keys read from the latest state that a stream keeps."""
    from spanlake.streaming.progress import streamed_latest

    ids = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    state = streamed_latest(spark, f"{sf_dir}/events.parquet", "user_id", ["ts", "event_id"], "event_type")
    return state.join(ids, "user_id", "left_semi").select("user_id", F.col("event_type").alias("stage"))


@register("S7_streamed_windows", """
SELECT * FROM (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
WHERE (day + 1) * 86400000 <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)""")
def streamed_windows(spark, sf_dir):
    """Counts by day on a stream: the days that the watermark, ten minutes behind the last event, has closed."""
    from spanlake.streaming.progress import drained, windowed

    counts = drained(spark, f"{sf_dir}/events.parquet", lambda e: windowed(e, "ts", "1 day", ["event_type"]))
    return counts.select(F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "event_type", "n")
