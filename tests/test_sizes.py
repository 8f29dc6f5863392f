"""What queries do only once, or not at all, so that they grow no faster than their input."""

import os

import pytest
from pyspark.sql import functions as F

from spanlake.operators import mining
from spanlake.operators.joins import overlap_join
from spanlake.plans import catalogue, more_queries
from spanlake.sources import json_arrays

QUERIES = catalogue.queries()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_range_reads_little_behind_its_end(tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text("[" + ",".join('{"id": %d}' % i for i in range(100_000)) + "]")
    read, grow = [], json_arrays.Window.grow
    monkeypatch.setattr(json_arrays.Window, "grow", lambda self: (n := len(self.data), grow(self), read.append(len(self.data) - n))[1])
    assert [o for o, _ in json_arrays.objects(str(path), 0, 5000, 0, False, 1)][-1] < 5000 and sum(read) < 20_000


@pytest.mark.parametrize("name, what, most", [("G12_hotword_union", "array_contains", 0), ("H2_char_ngrams", "array_sort", 0), ("H9_keyword_windows", "array_sort", 0), ("H18_local_score", "regexp_replace", 4)])
def test_planned_once(spark, sf_dir, name, what, most):
    assert plan(QUERIES[name](spark, sf_dir)).lower().count(what) <= most


def test_subtitle_files_share_a_folder(spark, sf_dir, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    monkeypatch.setattr(more_queries, "folder", lambda spark: out)
    n = QUERIES["A3_srt_files"](spark, sf_dir).where("pos = 1").count()
    assert not [d for d in os.listdir(out) if os.path.isdir(f"{out}/{d}")] and len([f for f in os.listdir(out) if f.endswith(".txt")]) >= n > 1


def test_texts_in_small_batches(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    QUERIES["F24_pack_paragraphs"](spark, sf_dir)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_terms_that_cannot_rank_are_not_joined(spark):
    docs = spark.createDataFrame([(i, ["often"] * 40 + ["twice"] * 30 + ["third"] * 20 + [f"own{i}_{j}" for j in range(50)] + ["rare"] * (8 if i == 3 else 0)) for i in range(20)], "doc_id long, w array<string>")
    found = mining.tf_idf(docs, "doc_id", F.col("w"), 3)
    rows = {(r.doc_id, r["rank"]): r.term for r in found.collect()}
    assert all([rows[i, k] for k in (1, 2, 3)] == ["often", "twice", "rare" if i == 3 else "third"] for i in range(20))
    assert "Repartition" in plan(found)


def shuffled(spark, work):
    """Rows that ``work`` shuffles where no join is broadcast."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    name, before = "spark.sql.autoBroadcastJoinThreshold", written()
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        work()
    finally:
        spark.conf.set(name, was)
    return sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize("name, most", [("F15_backfill_in_turn", 9), ("F15_backfill", 8), ("F9_removed_sections", 7), ("F9_validate_segments", 14)])
def test_captions_are_dealt_once(spark, sf_dir, name, most):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert shuffled(spark, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) <= most * events


@pytest.mark.parametrize("how", ["overlap", "within"])
def test_long_intervals_meet_as_often_at_one_level(spark, how):
    spans = [(i, 137 * i % 5000, 137 * i % 5000 + (i * i % 11) ** (i % 6)) for i in range(150)]
    left, right = (spark.createDataFrame([(1, *x) for x in spans[k::2]], f"k long, {s} long, {s}_start long, {s}_end long") for k, s in ((0, "l"), (1, "r")))
    test = (lambda a, b: a[1] <= b[1] and b[2] <= a[2]) if how == "within" else (lambda a, b: b[1] < a[2] and b[2] > a[1])
    expected = sorted((a[0], b[0]) for a in spans[::2] for b in spans[1::2] if test(a, b))
    for longest in (None, 100):
        assert sorted((p.l, p.r) for p in overlap_join(left, right, ["k"], 100, how, longest=longest).collect()) == expected
