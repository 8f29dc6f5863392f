"""Segments held against captions, and topics that grow one after another, on hand-written rows."""

import random

from pyspark.sql import functions as F

from spanlake.operators import validation

CAPS = "media_id long, pos long, seq long, r_start long, r_end long, continues boolean, depends boolean, leads_on boolean, switches boolean, ends boolean, hit boolean"


def caps(spark, rows):
    """(seq, start, end, flags) in seconds, in order; flags are letters: c, d, l, s, e, h."""
    full = [(1, i, q, a * 1000, b * 1000, *(x in f for x in "cdlseh")) for i, (q, a, b, f) in enumerate(rows, 1)]
    return spark.createDataFrame(full, CAPS)


def segs(spark, rows):
    return spark.createDataFrame([(1, c, i, a * 1000, b * 1000) for i, (c, a, b) in enumerate(rows)], "media_id long, clip long, seg long, l_start long, l_end long")


def run(spark, segments, captions, voiceless=None):
    quiet = None if voiceless is None else spark.createDataFrame([(1, a * 1000, b * 1000) for a, b in voiceless], "media_id long, r_start long, r_end long")
    kept, gone = validation.validate(segs(spark, segments), caps(spark, captions), ["media_id"], "clip", "seg", 60_000, 2000, 1000, 3000, 3000, 30_000, 3000, quiet)
    return sorted((r.clip, r.start_ms // 1000, r.end_ms // 1000) for r in kept.collect()), sorted((r.clip, r.start_ms // 1000, r.end_ms // 1000, r.reason) for r in gone.collect())


def test_snapped_and_cut_at_gaps(spark):
    captions = [(1, 0, 10, "e"), (2, 10, 20, "e"), (3, 30, 40, "e"), (4, 40, 50, "e"), (8, 50, 60, "e"), (9, 60, 70, "e"), (10, 90, 100, "e"), (11, 100, 110, "e")]
    # numbers jump from 4 to 8: the first clip ends before; the last caption of the second follows after a long gap
    assert run(spark, [(1, 5, 68), (2, 59, 101), (3, 71, 89)], captions) == ([(1, 10, 50), (2, 60, 70), (3, 71, 89)], [(1, 20, 30, "gap"), (2, 70, 90, "gap"), (3, 71, 89, "no captions")])


def test_no_caption_lies_inside(spark):
    captions = [(1, 0, 10, "e"), (2, 10, 20, "e")]
    assert run(spark, [(1, 4, 14)], captions)[0] == [(1, 0, 20)]
    heard = run(spark, [(1, 0, 10), (1, 30, 40)], captions, voiceless=[(50, 60)])
    assert heard == ([(1, 0, 10), (1, 30, 40)], [])
    assert run(spark, [(1, 0, 10), (1, 30, 40)], captions, voiceless=[(35, 60)]) == ([(1, 0, 10)], [(1, 30, 40, "no captions")])


def test_neighbours_join_and_run_on(spark):
    captions = [(1, 0, 10, "e"), (2, 10, 12, "e"), (3, 12, 20, "e"), (4, 20, 30, "eh"), (5, 30, 40, ""), (6, 40, 50, "e"), (7, 50, 60, "e"), (8, 60, 70, "e")]
    assert run(spark, [(1, 0, 10), (1, 12, 20)], captions)[0] == [(1, 0, 20)]  # a short caption between them
    assert run(spark, [(1, 12, 20), (1, 30, 40)], captions)[0] == [(1, 12, 50)]  # a hit between them, then on over an open sentence
    assert run(spark, [(1, 40, 50), (2, 60, 70)], captions)[0] == [(1, 40, 50), (2, 60, 70)]


def test_topics_grow_in_turn(spark):
    captions = [(1, 0, 10, "e"), (2, 10, 20, ""), (3, 20, 30, ""), (4, 30, 40, "e"), (5, 40, 50, "d"), (6, 50, 60, "e"), (7, 60, 70, "e")]
    rows = spark.createDataFrame([(1, 1, 10_000, 20_000), (1, 2, 40_000, 60_000)], "media_id long, topic long, l_start long, l_end long")

    def grown(order):
        t = rows.withColumn("topic", F.when(F.lit(order == "late"), 3 - F.col("topic")).otherwise(F.col("topic")))
        out = validation.backfill_in_turn(t, caps(spark, captions), ["media_id"], "topic", 60_000, 300_000, 5, 500)
        return sorted((s.start_ms // 1000, s.end_ms // 1000) for r in out.collect() for s in r.segments)

    # the first goes on to the end of its sentence; the second, whose caption depends on what came before, finds that taken
    assert grown("early") == [(10, 40), (40, 60)]
    alone = validation.backfill_in_turn(rows.where("topic = 2"), caps(spark, [*captions[:3], (4, 30, 40, "d"), *captions[4:]]), ["media_id"], "topic", 60_000, 300_000, 5, 500).collect()
    assert [(s.start_ms, s.end_ms) for s in alone[0].segments] == [(10_000, 60_000)]


def test_turns_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    captions, t = [], 0
    for i in range(200):
        t += r.choice([0, 0, 3])
        captions.append((i, t, t + r.randint(1, 9), "".join(x for x in "cdse" if r.random() < 0.3)))
        t = captions[-1][2]
    rows = spark.createDataFrame([(1, i, a * 1000, (a + r.randint(5, 40)) * 1000) for i, a in enumerate(sorted(r.sample(range(t), 40)))], "media_id long, topic long, l_start long, l_end long")
    one = [sorted(map(str, validation.backfill_in_turn(x, caps(spark, captions), ["media_id"], "topic", w, 60_000, 5, 500).collect())) for x, w in ((rows, 60_000), (rows.repartition(7), 5000))]
    assert one[0] == one[1] and len(one[0]) == 40


def test_composition_is_planned_step_by_step(spark, sf_dir):
    from spanlake.plans import catalogue

    # one plan of all steps took the driver's memory
    assert len(catalogue.queries()["X14_topic_composition"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_sections_alone_are_those_of_the_whole(spark):
    captions = [(1, 0, 10, "e"), (2, 10, 20, "e"), (3, 30, 40, "e"), (4, 40, 50, "e"), (8, 90, 100, "e")]
    rows = [(1, 0, 50), (1, 35, 101), (2, 60, 70), (3, 72, 80)]
    quiet = spark.createDataFrame([(1, 65_000, 71_000)], "media_id long, r_start long, r_end long")
    gone = validation.sections(segs(spark, rows), caps(spark, captions), ["media_id"], "clip", "seg", 60_000, 2000, 1000, quiet)
    found = sorted((r.clip, r.start_ms // 1000, r.end_ms // 1000, r.reason) for r in gone.collect())
    assert found == run(spark, rows, captions, [(65, 71)])[1] == [(1, 20, 30, "gap"), (1, 50, 90, "gap"), (2, 60, 70, "no captions")]
