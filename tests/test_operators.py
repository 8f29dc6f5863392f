"""Operators on hand-written rows, algebra laws on random intervals, and streams against tables."""

import os
import random

from pyspark.sql import functions as F

from spanlake.functions import text as tx
from spanlake.functions import times
from spanlake.operators import folds, intervals, joins, mining, relational, topics
from spanlake.sources import srt
from spanlake.streaming import progress


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def spans(spark, rows):
    return spark.createDataFrame(rows, "media_id long, start_ms long, end_ms long")


def test_merge_with_gap(spark):
    df = spans(spark, [(1, 0, 5000), (1, 7000, 10000), (1, 11000, 15000), (2, 3, 4)])
    assert rows_of(intervals.merge(df, ["media_id"], 1000), "media_id", "start_ms", "end_ms") == [(1, 0, 5000), (1, 7000, 15000), (2, 3, 4)]
    assert intervals.merge(df.limit(0), ["media_id"]).count() == 0


def test_interval_laws(spark):
    r = random.Random(1)
    rows = [(k, a, a + r.randint(1, 40)) for k in range(4) for a in r.sample(range(400), 25)]
    cover = {(k, t) for k, a, b in rows for t in range(a, b)}
    merged = intervals.merge(spans(spark, rows), ["media_id"])
    points = lambda df: {(x.media_id, t) for x in df.collect() for t in range(x.start_ms, x.end_ms)}
    assert points(merged) == cover
    assert rows_of(intervals.merge(merged.drop("n_segments"), ["media_id"]), "media_id", "start_ms", "end_ms") == rows_of(merged, "media_id", "start_ms", "end_ms")
    rest = intervals.complement(spans(spark, rows).withColumn("total", F.lit(500)), ["media_id"], "total")
    assert points(rest) == {(k, t) for k in range(4) for t in range(500)} - cover
    segments = spans(spark, [(k, 50, 300) for k in range(4)]).withColumn("sid", F.col("media_id"))
    assert points(intervals.subtract(segments, spans(spark, rows), ["media_id"], "sid", 64)) == {(k, t) for k in range(4) for t in range(50, 300)} - cover


def test_slices_change_nothing(spark):
    """Keys cut into slices of time give what whole keys give."""
    r = random.Random(7)
    rows = [(k, i, a, a + r.choice([1, 5, 30, 400])) for i in range(300) for k, a in [(r.choice([1, 1, 1, 2, 3]), r.randint(0, 2000))]]
    df = spark.createDataFrame(rows, "media_id long, event_id long, start_ms long, end_ms long")
    other = spark.createDataFrame([(k, t, f"v{t % 7}") for k in (1, 2) for t in r.sample(range(-50, 2100), 40)], "media_id long, t long, v string")
    for width in (7, 100, 10_000):
        for gap in (0, 12):
            for f in (lambda s: intervals.merge(df, ["media_id"], gap, order=["event_id"], slice_ms=s), lambda s: intervals.sessions(df, ["media_id"], gap + 1, ["event_id"], slice_ms=s)):  # noqa: B023
                assert sorted(f(width).collect(), key=str) == sorted(f(None).select(f(width).columns).collect(), key=str)
        for f in (
            lambda s: intervals.complement(df.withColumn("total", F.lit(2500)), ["media_id"], "total", slice_ms=s), lambda s: joins.asof(df, other, ["media_id"], "start_ms", "t", "v", slice_ms=s),
            lambda s: joins.asof(df, other, ["media_id"], "start_ms", "t", "v", "forward", slice_ms=s),
        ):
            assert sorted(f(width).collect(), key=str) == sorted(f(None).collect(), key=str)


def test_overlap_join_bins(spark):
    r = random.Random(2)
    left = [(k, i, a, a + r.randint(0, 90)) for i in range(60) for k, a in [(r.randint(0, 2), r.randint(0, 500))]]
    right = [(k, i, a, a + r.randint(0, 90)) for i in range(60) for k, a in [(r.randint(0, 2), r.randint(0, 500))]]
    a = spark.createDataFrame(left, "k long, l long, l_start long, l_end long")
    b = spark.createDataFrame(right, "k long, r long, r_start long, r_end long")
    for how, closed, test in (("overlap", False, lambda x, y: y[2] < x[3] and y[3] > x[2]), ("overlap", True, lambda x, y: y[2] <= x[3] and y[3] >= x[2]), ("within", False, lambda x, y: y[2] >= x[2] and y[3] <= x[3])):
        found = joins.overlap_join(a, b, ["k"], 37, how, closed)
        assert rows_of(found, "l", "r") == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and test(x, y))


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(1, t) for t in (0, 5, 10, 14, 30)] + [(2, 3)], "k long, at long")
    right = spark.createDataFrame([(1, 5), (1, 10), (1, 20)], "k long, ts long")
    found = joins.nearest(left, right, ["k"], "at", "ts")
    assert sorted(found.select("k", "at", "previous", "next", "nearest").collect()) == [(1, 0, 5, 5, 5), (1, 5, 5, 5, 5), (1, 10, 10, 10, 10), (1, 14, 10, 20, 10), (1, 30, 20, 20, 20), (2, 3, None, None, None)]


def test_times(spark):
    df = spark.createDataFrame([("00:01:02,345",), ("00:01:02.5",), ("1:2",), ("7.25",), ("x",), (None,)], "t string")
    got = df.select(times.parse_ms(F.col("t")), times.parse_ms(F.col("t"), "lenient"), times.parse_ms(F.col("t"), "zero")).collect()
    assert [tuple(r) for r in got] == [(62345, 62345, 62345), (62500, 62500, 62500), (None, 62000, 0), (None, 7250, 0), (None, 0, 0), (None, 0, 0)]
    stamp = spark.range(1).select(times.format_ms(F.lit(59_999_600)), times.format_ms(F.lit(3_661_005), "dotted"), times.format_ms(F.lit(360_000_000), "plain")).first()
    assert tuple(stamp) == ("16:39:59,600", "01:01:01.005", "100:00:00")


def test_text(spark):
    row = spark.createDataFrame([("the quick fox", "a quick brown fox", " Ann: hello!")], "a string, b string, c string").select(
        tx.title_similarity(F.col("a"), F.col("a"), []), F.round(tx.title_similarity(F.col("a"), F.col("b"), ["the"]), 4), tx.speaker_of(F.col("c")), tx.ends_sentence(F.col("c")),
        tx.char_ngrams(F.lit("ab"), 3), tx.squeeze_repeats(F.lit("soooo aa")), tx.fallback_title(F.lit(" "), F.lit("x" * 40)), tx.estimate_tokens(F.lit("你好 world")),
    ).first()
    assert tuple(row) == (1.0, round(0.5 * 2 / 3 + 0.2 * 13 / 17 + 0.3, 4), "Ann", True, [], "so aa", "x" * 30 + "...", 5)


def test_similarity_and_components(spark):
    r = random.Random(3)
    sets = {i: {r.choice("abcdefghijkl") + r.choice("xy") for _ in range(r.randint(1, 9))} | {"common"} for i in range(50)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "k long, g array<string>")
    reps = dict(rows_of(mining.set_classes(df, "k", F.col("g")), "k", "rep"))
    assert reps == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    found = {(x.a, x.b): (x.n_a, x.n_b) for x in mining.similar_pairs(df, "k", F.col("g"), 0.7).collect()}
    assert all(n == tuple(list(reps.values()).count(k) for k in pair) for pair, n in found.items())
    pairs = sorted((a, b) for a in sets for b in sets if a < b and (reps[a] == reps[b] or tuple(sorted((reps[a], reps[b]))) in found))
    expected = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5 >= 0.7 - 1e-9)
    assert pairs == expected
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (50, 70)], "a long, b long")
    assert dict(rows_of(mining.components(edges), "node", "root")) == {**dict.fromkeys(range(21), 0), 50: 50, 70: 50, 100: 50}


def test_relational(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, None, 0)], "k long, v string, x long")
    s = spark.createDataFrame([(2, None), (4, "d")], "k long, v string")
    got = {r.k: (r.v, r.x) for r in relational.upsert(t, s, ["k"], ["v"]).collect()}
    assert got == {1: ("a", 0), 2: (None, 0), 3: (None, 0), 4: ("d", None)}
    assert rows_of(relational.page(t, [F.desc("k")], 2, 2), "k") == [(1,)]
    flat = spark.createDataFrame([(1, i, 0.5) for i in range(3)] + [(2, 0, 0.5)], "k long, i long, s double")
    assert [round(r.s, 2) for r in relational.diversify(flat, ["k"], "s", [F.col("i")]).orderBy("k", "i").collect()] == [0.4, 0.5, 0.6, 0.5]


def test_stream_equals_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for path in (f"{sf_dir}/events.parquet", str(tmp_path / "events.parquet")):
        if path.startswith(str(tmp_path)):
            events.repartition(3).write.parquet(path)
        assert sorted(progress.drained(spark, path).collect()) == sorted(events.collect())


def test_suppression_is_greedy(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 2), i, r.randint(0, 5), a, a + r.randint(1, 60)) for i in range(120) for a in [r.randint(0, 300)]]
    found = topics.suppress(spark.createDataFrame(rows, "k long, id long, score long, start_ms long, end_ms long"), ["k"], "id", "score", 50, 0.4)
    kept = []
    for x in sorted(rows, key=lambda x: (-x[2], x[4] - x[3], x[1])):
        shared = lambda y: min(x[4], y[4]) - max(x[3], y[3])  # noqa: B023, E731
        if all(y[0] != x[0] or shared(y) <= 0 or shared(y) <= 0.4 * (x[4] - x[3] + y[4] - y[3] - shared(y)) for y in kept):
            kept.append(x)
    assert rows_of(found, "id") == sorted((x[1],) for x in kept)


def test_pairs_do_not_chain(spark):
    rows = [(1, i, f) for i, f in enumerate([False, True, True, True, False, True])]
    found = topics.merge_flagged_pairs(spark.createDataFrame(rows, "k long, i long, f boolean"), ["k"], ["i"], F.col("f"))
    assert [x.pair for x in found.orderBy("i").collect()] == [1, 1, 2, 2, 3, 3]


def test_subtitles(spark, tmp_path):
    text = "\ufeff1\r\n00:00:05,000 --> 00:00:06,500\r\nlater\r\nline\r\n\r\nx\n00:00:01.000 --> 00:00:02.000\nfirst\n\n3\nno stamp\nbad\n\n4\n00:00:09,000 --> 00:00:10,000"
    (tmp_path / "a.srt").write_text(text, encoding="utf-8")
    found = srt.parse(srt.read_files(spark, str(tmp_path / "*.srt")), ["path"]).orderBy("pos").collect()
    assert [(x.pos, x.seq_num, x.start_ms, x.end_ms, x.text) for x in found] == [(1, None, 1000, 2000, "first"), (2, 1, 5000, 6500, "later line")]
    again = srt.parse(srt.render(spark.createDataFrame([(1, 2, 5000, 6500, "b"), (1, 1, 0, 10, "a")], "k long, i long, start_ms long, end_ms long, text string"), ["k"], "i"), ["k"])
    assert [(x.pos, x.start_ms, x.text) for x in again.orderBy("pos").collect()] == [(1, 0, "a"), (2, 5000, "b")]


def test_sequence_matcher(spark):
    from spanlake.functions.matching import sequence_ratio

    assert spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(sequence_ratio("a", "b")).first()[0] == 0.75


def test_absorbing_and_packing(spark):
    r = random.Random(5)
    rows = [(k, i, a, a + r.randint(1, 30)) for i in range(60) for k, a in [(r.randint(0, 3), r.randint(0, 400))]]
    titles = ["red shoes", "red shoes here", "a blue coat", "tea"]
    df = spark.createDataFrame([(*x, titles[x[1] % 4]) for x in rows], "k long, id long, start_ms long, end_ms long, title string")
    found = topics.absorb_short(df, ["k"], "id", "title", F.col("end_ms") - F.col("start_ms") <= 12, 20, 4, [])
    alike = {(a, b): a == b or {a[:3], b[:3]} == {"red"} for a in titles for b in titles}
    assert all(v == (spark.range(1).select(tx.title_similarity(F.lit(a), F.lit(b), [])).first()[0] > 0.35) for (a, b), v in alike.items())
    expected = []
    for k in range(4):
        done = []
        for a, i, b in sorted((x[2], x[1], x[3]) for x in rows if x[0] == k):
            t = titles[i % 4]
            gap = a - done[-1][1] if done else None
            if done and b - a <= 12 and -1000 <= gap <= 20 and (gap < 4 or alike[done[-1][4], t]):
                done[-1] = (done[-1][0], max(done[-1][1], b), done[-1][2], done[-1][3] + 1, done[-1][4])
            else:
                done.append((a, b, i, 1, t))
        expected += [(k, i, a, b, n) for a, b, i, n, _ in done]
    assert rows_of(found, "k", "id", "start_ms", "end_ms", "n") == sorted(expected)


def test_packing():
    r = random.Random(5)
    for _ in range(50):
        text = "\n".join("".join(r.choice("abc .") for _ in range(r.choice([0, 10, 40, 200]))) for _ in range(12))
        got = topics.packed(text, 60)
        squeezed = lambda t: "".join(t.split()).replace(".", "")
        assert squeezed("".join(got)) == squeezed(text)  # nothing is lost but blanks and marks
        assert all(len(c) <= 60 or c.count(".") <= 1 for c in got)
    assert topics.packed("short\ntext", 60) == ["short\ntext"] and topics.packed(None, 60) == [] and topics.packed("", 60) == [""]
    assert topics.packed("aaaa\nbbbb\ncccc", 10) == ["aaaa\nbbbb", "cccc"]
    assert topics.packed("x\naaaa.bbbb.cc\nd", 10) == ["x", "aaaa.bbbb.", "cc.d"]


def test_folds_are_streamed(spark):
    rows = [(k, i) for k in range(5) for i in range(3000)]
    r = random.Random(1)
    r.shuffle(rows)

    def step(part):
        seen = 0
        for x in part:
            seen += x["i"] == seen
            yield {"k": x["k"], "seen": seen}

    found = folds.fold(spark.createDataFrame(rows, "k long, i long"), ["k"], ["i"], step, "k long, seen long")
    assert rows_of(found, "k", "seen") == sorted((k, i + 1) for k, i in rows)


def test_late_rows_and_time_to_live(spark, tmp_path):
    """Three micro-batches: rows behind the watermark of the first are late in the third, open windows and values wait."""
    hour = 3_600_000_000
    stamp = lambda df: df.withColumn("ts", F.timestamp_micros(F.col("ts") + 240 * hour))
    batches = [[(1, 0, 0, "a"), (2, 1, hour // 2, "a"), (3, 2, 30 * hour, "b")], [(5, 0, 31 * hour, "a")], [(4, 0, 5 * hour, "a"), (6, 3, 80 * hour, "b")]]
    path = str(tmp_path / "events")
    for k, rows in enumerate(batches):
        df = stamp(spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string"))
        df.coalesce(1).write.mode("append").parquet(path)
        for f in (tmp_path / "events").glob("*.parquet"):
            if f.stat().st_mtime > 2_000_000:  # the older file comes first
                os.utime(f, (1_000_000 + k, 1_000_000 + k))
    counted = progress.drained(spark, path, lambda e: progress.windowed(e, "ts", "1 day", ["event_type"]), files=1)
    assert sorted((x.start.day, x.event_type, x.n) for x in counted.collect()) == [(11, "a", 2), (12, "a", 1), (12, "b", 1)]
    found = progress.drained(spark, path, lambda e: progress.expired(e, "user_id", "event_id", "ts", hour), files=1)
    assert rows_of(found, "event_id") == [(1,), (2,), (3,), (5,)]  # 4 came late, 6 is still valid
    latest = progress.streamed_latest(spark, path, "user_id", ["ts", "event_id"], "event_type", files=1)
    assert rows_of(latest, "user_id", "event_id") == [(0, 5), (1, 2), (2, 3), (3, 6)]


def test_upserts_by_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = progress.upserted(spark, str(tmp_path / "events.parquet"), "user_id", ["ts", "event_id"], "event_type")
    assert sorted(got.collect()) == sorted(progress.latest(events, "user_id", ["ts", "event_id"], "event_type").collect())


def test_lloyd_rounds(spark):
    import hashlib

    r = random.Random(2)
    rows = [(i * 7, r.randint(0, 40) + 100 * (i % 3), r.randint(0, 9)) for i in range(120)] + [(1001, 5, 5), (1002, 5, 5)]
    weights, k = (0.5, 2.0), 4
    centres = [[float(a), float(b)] for _, a, b in sorted(rows, key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest(), x[0]))[:k]]
    labels = [0] * len(rows)
    for _ in range(20):
        far = [[sum(((v - c) * w) * ((v - c) * w) for v, c, w in zip(x[1:], centre, weights)) for centre in centres] for x in rows]
        new = [d.index(min(d)) for d in far]
        if new == labels:
            break
        labels = new
        for j in range(k):
            if own := [x for x, n in zip(rows, labels) if n == j]:
                centres[j] = [sum(x[i] for x in own) / len(own) for i in (1, 2)]
    df = spark.createDataFrame(rows, "id long, a long, b long").repartition(3)
    for most in (20, 1):
        found = {x.id: x.cluster for x in mining.lloyd(df, "id", [F.col("a"), F.col("b")], weights, k, most).collect()}
        if most == 20:
            assert found == {x[0]: n for x, n in zip(rows, labels)} and len(set(labels)) == k
    few = mining.lloyd(df.where("id > 1000"), "id", [F.col("a"), F.col("b")], weights, k).collect()
    assert sorted((x.id, x.cluster) for x in few) == [(1001, 0), (1002, 1)]
    assert mining.lloyd(df.limit(0), "id", [F.col("a"), F.col("b")], weights, k).count() == 0


def test_titles_compared_one_by_one(spark):
    from spanlake.functions import text as tx
    from spanlake.functions import titles

    names = ["", "the end", "The End", "click view", "view", "ends of days", "day ends", "die Tür", "tür", None, "xy"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    stop = ["the", "die"]
    found = pairs.select("a", "b", tx.keywords(F.col("a"), stop).alias("ka"), tx.keywords(F.col("b"), stop).alias("kb"), tx.title_similarity(F.col("a"), F.col("b"), stop).alias("s"), tx.jaccard(tx.keywords(F.col("a"), stop), tx.keywords(F.col("b"), stop)).alias("j")).collect()
    for r in found:
        ka, kb = (None if k is None else tuple(k) for k in (r.ka, r.kb))
        assert (titles.similarity(r.a, ka, r.b, kb), titles.shared(ka, kb)) == (r.s or 0.0, r.j), r


def test_outlines_of_one_large_key(spark):
    # a key of 4,000 outlines of a few titles: titles are compared once, not for each pair of rows in one expression
    rows = spark.range(4000).select(F.lit(1).alias("k"), "id", F.concat(F.lit("title "), F.col("id") % 7).alias("title"), (F.col("id") % 13).alias("c"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 5).alias("end_ms"))
    kept = topics.merge_outlines(rows, ["k"], "id", "title", "c", ["the"])
    assert "zip_with" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id % 13 for r in kept.collect()} == {12}


def test_similar_pairs_list_no_pair_before_it_is_bounded(spark, monkeypatch):
    r = random.Random(5)
    # every set holds one of two frequent elements, so that nearly all pairs share something; few are similar
    sets = [sorted({r.choice(["x", "y"]), *(f"w{r.randint(0, 400)}" for _ in range(r.randint(3, 30)))}) for _ in range(300)]
    sets += [[*s, "z"] for s in sets[:20]] + [sets[0]]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, g array<string>")
    by = {}
    for k, s in enumerate(sets):
        by.setdefault(frozenset(s), []).append(k)
    reps = sorted((min(ks), len(ks), s) for s, ks in by.items())
    wanted = {(a, b, round(c, 6), n, m) for i, (a, n, s) in enumerate(reps) for b, m, t in reps[i + 1 :] if (c := len(s & t) / (len(s) * len(t)) ** 0.5) >= 0.35}
    for group, block in ((16_384, 1024), (50, 7)):
        monkeypatch.setattr(mining, "_GROUP", group)
        monkeypatch.setattr(mining, "_BLOCK", block)
        monkeypatch.setattr(mining, "_OWN", 20)
        found = mining.similar_pairs(df, "k", F.col("g"), 0.35)
        assert {tuple(x) for x in found.collect()} == wanted and len(wanted) > 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan


def test_similar_pairs_are_compared_where_they_are_found(spark, monkeypatch):
    r = random.Random(11)
    # few frequent elements and many rare ones; sets from one to 400 elements, and near copies, so that every way of counting is taken
    words = [f"w{i}" for i in range(600)]
    sets = [sorted({words[min(int(r.expovariate(1 / 60)), 599)] for _ in range(r.choice([1, 3, 8, 20, 60, 200, 1500]))}) for _ in range(350)]
    sets += [sorted({*s[1:], "new"}) for s in sets[:40]] + [words, words[:-3], sets[7]]
    df = spark.createDataFrame([(f"k{k:03}", s) for k, s in enumerate(sets)], "k string, g array<string>")
    by = {}
    for k, s in enumerate(sets):
        by.setdefault(frozenset(s), []).append(f"k{k:03}")
    reps = sorted((min(ks), len(ks), s) for s, ks in by.items())
    for threshold in (0.35, 0.8):
        wanted = {(a, b, round(c, 6), n, m) for i, (a, n, s) in enumerate(reps) for b, m, t in reps[i + 1 :] if (c := len(s & t) / (len(s) * len(t)) ** 0.5) >= threshold}
        for group, own, block in ((10**6, 256, 512), (90, 64, 8)):
            monkeypatch.setattr(mining, "_GROUP", group)
            monkeypatch.setattr(mining, "_OWN", own)
            monkeypatch.setattr(mining, "_BLOCK", block)
            found = mining.similar_pairs(df, "k", F.col("g"), threshold)
            assert {tuple(x) for x in found.collect()} == wanted and len(wanted) > 20
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_every_way_of_counting_shared_elements(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from spanlake.operators import overlaps

    r = random.Random(12)
    sets = [r.sample(range(900), r.choice([1, 2, 5, 30, 300, 700])) for _ in range(200)] + [list(range(300)), list(range(1, 301))]
    at = [i % 2 for i in range(len(sets))]
    table = pa.table({"k": list(range(len(sets))), "n": [1] * len(sets), "g": pa.array(sets, pa.list_(pa.int64())), "at": pa.array(at, pa.int32())})
    # frequent elements as products, one small step after another, without many bits
    for dense, columns, step, own in ((1 / 128, 512, 1 << 21, 256), (1e-9, 7, 1 << 21, 64), (2.0, 512, 50, 64)):
        monkeypatch.setattr(overlaps, "DENSE", dense)
        monkeypatch.setattr(overlaps, "COLUMNS", columns)
        monkeypatch.setattr(overlaps, "STEP", step)
        for alone, part in ((False, table), (True, table.filter(pa.array(np.array(at) == 0)))):
            ids = part["k"].to_pylist()
            wanted = {(a, b, len({*sets[a]} & {*sets[b]}), len(sets[a]), len(sets[b])) for a in ids for b in ids if a < b and (alone or at[a] != at[b])}
            wanted = {w for w in wanted if w[2] / (w[3] * w[4]) ** 0.5 >= 0.5}
            found = [tuple(x.values())[:5] for batch in overlaps.links(part, alone, 0.5, own, 16) for x in batch.to_pylist()]
            found = [f for f in found if f[2] / (f[3] * f[4]) ** 0.5 >= 0.5]
            assert sorted(found) == sorted(wanted) and len(wanted) > 20


def test_linked_rows_need_no_clusters(spark, monkeypatch):
    sets = [["a", "b"], ["a", "b"], ["a", "b", "c"], ["x"], ["y", "z"], ["y", "z"], ["q"], []]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, g array<string>")
    classes = mining.set_classes(df, "k", F.col("g"))
    monkeypatch.setattr(mining, "components", None)
    pairs = mining.similar_pairs(df, "k", F.col("g"), 0.5)
    assert mining.linked_rows(pairs, classes).first()[0] == 5
    assert mining.linked_rows(pairs.limit(0), classes.where("k IN (3, 6)")).first()[0] == 0


def test_components_of_many_links_and_long_paths(spark, monkeypatch):
    r = random.Random(4)
    ids = list(range(1000))
    r.shuffle(ids)
    # a path in order, one in no order, a dense part, a loop and a doubled link
    edges = [(i, i + 1) for i in range(2000, 2300)] + list(zip(ids[:300], ids[1:301], strict=True)) + [(r.randint(5000, 5080), r.randint(5000, 5080)) for _ in range(3000)] + [(7000, 7000), (9, 8000), (8000, 9)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    df = spark.createDataFrame(edges, "a long, b long")
    cuts = []
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, f=type(df).checkpoint, **b: cuts.append(1) or f(self, *a, **b))
    for few, most in ((10**6, 3), (100, 36), (0, 48)):
        monkeypatch.setattr(mining, "_FEW", few)
        cuts.clear()
        found = mining.components(df).collect()
        assert {x.node: x.root for x in found} == {x: find(x) for x in root} and len(found) == len(root)
        assert len(cuts) < most
        names = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in [(3, 2), (2, 1), (5, 4)]], "a string, b string")
        assert dict(rows_of(mining.components(names), "node", "root")) == {"n1": "n1", "n2": "n1", "n3": "n1", "n4": "n4", "n5": "n4"}
    assert mining.components(df.limit(0)).count() == 0


def test_inner_similarity_computes_clusters_once(spark):
    r = random.Random(8)
    sets = [sorted({r.choice("abcdefghij") for _ in range(r.randint(1, 4))}) for _ in range(40)] + [["x", "y"], ["x", "y"], ["q"]]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, g array<string>")
    classes, pairs = mining.set_classes(df, "k", F.col("g")), mining.similar_pairs(df, "k", F.col("g"), 0.6)
    clusters = mining.similar_clusters(pairs, classes)
    inner = mining.inner_similarity(pairs.checkpoint(), classes.checkpoint(), clusters)
    assert "xxhash64" not in inner._jdf.queryExecution().optimizedPlan().toString()
    root = {x.node: x.root for x in clusters.collect()}
    alike = lambda a, b: 1.0 if sets[a] == sets[b] else round(len({*sets[a]} & {*sets[b]}) / (len(sets[a]) * len(sets[b])) ** 0.5, 6)
    for x in inner.collect():
        of = [k for k in root if root[k] == x.root]
        linked = [s for i, a in enumerate(of) for b in of[i + 1 :] if (s := alike(a, b)) >= 0.6]
        assert x.n == len(of) and abs(x["mean"] - sum(linked) / (len(of) * (len(of) - 1) / 2)) < 1e-9
    assert len({*root.values()}) > 1
