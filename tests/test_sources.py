"""Files by byte ranges against their whole contents; file times; streams of files."""

import json
import os
import random
import re

import pytest

from spanlake.functions.unicode import normalised
from pyspark.sql.functions import lit, udf

from spanlake.sources import files, json_arrays, ranges, subtitles, versions


@pytest.mark.parametrize("divider", [subtitles._BLANK, subtitles._PLAIN])
def test_blocks_of_ranges(tmp_path, divider):
    r = random.Random(0)
    for trial in range(150):
        parts = []
        for i in range(r.randint(0, 12)):
            block = r.choice([f"{i}\n00:00:01,000 --> 00:00:12.500\nhello {'x' * r.randint(0, 30)}\nmore", "x", "a\nb\nc", "1\nbad --> stamp\ntext  "])
            parts.append(block + r.choice(["\n\n", "\n \n", "\n\n\n\n", "\r\n\r\n", "\n  \t \n\n ", "\n"]))
        raw = (r.choice(["", "\n\n", "﻿", "  \n"]) + "".join(parts)).encode()
        path = tmp_path / f"{trial}.srt"
        path.write_bytes(raw)
        width, chunk = r.randint(1, 40), r.randint(1, 50)
        found = [b.strip() for lo, hi in ranges.ranges_of(len(raw), width) for _, b in subtitles.blocks(str(path), lo, hi, divider, chunk)]
        assert found == [b.strip() for b in re.split(divider.pattern, raw) if b.strip()]


def test_a_large_subtitle_file(spark, tmp_path):
    """One file, many ranges: each caption once, wherever a range begins."""
    n = 20_000
    stamp = lambda i: f"{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d},{i % 1000:03d}"
    (tmp_path / "long.srt").write_text("".join(f"{i}\n{stamp(i)} --> {stamp(i + 1)}\ncaption {i}\nline\n\n" for i in range(n)), newline="")
    (tmp_path / "empty.srt").write_text("")
    (tmp_path / "_hidden.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nno")
    subtitles.register(spark)
    found = spark.read.format("subtitles").option("path", str(tmp_path)).option("pattern", "*.srt").option("range_bytes", 50_000).load()
    assert found.rdd.getNumPartitions() > 15
    rows = sorted((r.seq_num, r.start_ms, r.text) for r in found.collect())
    assert rows == [(i, i * 1000 + i % 1000, f"caption {i} line") for i in range(n)]
    with pytest.raises(Exception, match="grammar"):
        spark.read.format("subtitles").option("path", str(tmp_path)).option("grammar", "other").load().count()


def test_a_stream_of_subtitle_files(spark, tmp_path):
    subtitles.register(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        stream = spark.readStream.format("subtitles").option("path", str(source)).option("range_bytes", 40).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(out))
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.text for r in spark.read.parquet(str(out)).collect())

    block = "1\n00:00:01,000 --> 00:00:02,000\n{}\n\n"
    (source / "a.srt").write_text(block.format("one") + block.format("two"))
    assert run() == ["one", "two"]
    (source / "b.srt").write_text(block.format("three") * 2)
    assert run() == ["one", "three", "three", "two"]
    assert run() == ["one", "three", "three", "two"]


def test_json_objects_of_ranges(tmp_path):
    """Objects of arrays, plain and wrapped, from ranges and chunks of any width, with brackets and quotes in strings."""
    r = random.Random(0)
    value = lambda: r.choice([1, 'x{["\\', '\\\\"}', None, [1, {"a": "]"}], {"q": {"clips": [{"z": 1}]}}, "ä{é"])
    for trial in range(120):
        objects = [{r.choice('abc"'): value() for _ in range(r.randint(0, 3))} for _ in range(r.randint(0, 8))]
        document = [objects, {"n": value(), "clips": objects, "m": value()}, {"other": {"clips": [{"no": 1}]}, "data": {"x": value(), "clips": objects}}, {"none": value()}][trial % 4]
        path = str(tmp_path / f"{trial}.json")
        raw = json.dumps(document, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5).encode()
        open(path, "wb").write(raw)
        chunk, known, depth, inside = r.randint(1, 20), [], 0, False
        for lo, hi in ranges.ranges_of(len(raw), r.randint(1, 30)):
            known.append((lo, hi, depth, inside))
            change, inside = json_arrays.summary(path, lo, hi, chunk)[inside]
            depth += change
        assert depth == 0 and not inside
        events = lambda level, a, b: sorted(e for k in known for e in json_arrays.events(path, *k, level, chunk) if a < e[0] < b)  # noqa: B023, E731
        first = events(0, -1, 1 << 62)[0]
        spot, at = ((first[0], 1 << 62), 1) if trial % 4 == 0 else (None, 0)
        for option in (("clips",), ("data", "clips")) if trial % 4 else ():
            within = (first[0], 1 << 62)
            for level, key in enumerate(option, 1):
                within = within and json_arrays.under(events(level, *within), path, key, "[" if level == len(option) else "{")
            spot, at = (within, len(option) + 1) if spot is None and within else (spot, at)
        found = [json.loads(t) for lo, hi, d, i in known if spot and lo < spot[1] and hi > spot[0] for o, t in json_arrays.objects(path, lo, min(hi, spot[1]), d, i, at, chunk) if o >= spot[0]]
        assert found == (objects if trial % 4 < 3 else [])


def test_json_arrays(spark, tmp_path):
    rows = [{"id": i, "t": "x" * (i % 50) + '"]}{['} for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"clips": rows, "data": {"clips": [{"id": -1}]}}, indent=2))
    (tmp_path / "c.json").write_text(json.dumps({"data": {"clips": rows}, "z": 1}))
    for name, text in (("d.json", "{}"), ("e.json", "[]"), ("f.json", ""), ("g.json", "3"), ("h.json", '{"clips": {"no": [1]}}')):
        (tmp_path / name).write_text(text)
    found = json_arrays.read(spark, str(tmp_path), "id long, t string", ((), ("clips",), ("data", "clips")), width=5000).collect()
    by = {}
    for x in found:
        by.setdefault(x.path.rsplit("/", 1)[-1], []).append((x.offset, x.id, x.t))
    assert set(by) == {"a.json", "b.json", "c.json"}
    for own in by.values():
        assert [(i, t) for _, i, t in sorted(own)] == [(x["id"], x["t"]) for x in rows]
    only = json_arrays.read(spark, str(tmp_path), "id long", ((),), width=5000)
    assert {p.path.rsplit("/", 1)[-1] for p in only.select("path").distinct().collect()} == {"a.json"}


def test_file_times(spark, tmp_path):
    for name, at in (("old.txt", 1_600_000_000), ("new.txt", 1_700_000_000)):
        (tmp_path / name).write_text(name * 3)
        os.utime(tmp_path / name, (at, at))
    every = {r.name: (r.length, r.modified.timestamp()) for r in files.listing(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in every.items()} == {"old.txt": 21, "new.txt": 21}
    assert [r.name for r in files.listing(spark, str(tmp_path), before="2022-01-01T00:00:00").collect()] == ["old.txt"]
    assert [r.name for r in files.listing(spark, str(tmp_path), after="2022-01-01T00:00:00").collect()] == ["new.txt"]


def test_normal_form(spark):
    texts = ["ＡＢＣ１２", "ﬁne", "é", "①", None, "", "plain"]
    got = [r.t for r in normalised(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), "t").collect()]
    assert got == ["ABC12", "fine", "é", "1", None, "", "plain"]


def test_stored_versions(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, name string, score double")
    table = versions.Versions(spark, str(tmp_path / "t"), ["id"])
    with pytest.raises(FileNotFoundError):
        table.read()
    table.create(rows((1, "a", 1.0), (2, "b", None), (3, "c", 3.0)))
    now = lambda version=None: sorted(tuple(r) for r in table.read(version).select("id", "name", "score").collect())
    with pytest.raises(ValueError, match="stored already"):
        table.create(rows((3, "again", 0.0)))
    table.update(spark.createDataFrame([(2, 9.0), (7, 7.0)], "id long, score double"))
    assert now() == [(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)]
    table.delete(rows((1, "", 0.0), (8, "", 0.0)))
    assert now() == [(2, "b", 9.0), (3, "c", 3.0)] and table.version == 2
    broken = udf(lambda i: 1 / 0, "string")
    with pytest.raises(Exception, match="division"):
        table.update(table.read().select("id", broken("id").alias("name")))
    assert now() == [(2, "b", 9.0), (3, "c", 3.0)] and table.version == 2
    (tmp_path / "t" / "manifest" / "000000000003.json").write_text('{"version": 3, "fold')  # a writer lost half way
    assert now() == [(2, "b", 9.0), (3, "c", 3.0)]
    assert table.compact() == 4 and table.create(rows((1, "back", 0.5))) == 5
    assert now() == [(1, "back", 0.5), (2, "b", 9.0), (3, "c", 3.0)]
    assert now(0) == [(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)] and now(1)[1] == (2, "b", 9.0)
    assert sorted(r.id for r in table.first().collect()) == [1, 2, 3]
    seen = table._manifest()
    table.delete(rows((2, "", 0.0)))
    with pytest.raises(versions.Conflict):
        table._store_rows(rows((9, "late", 0.0)).withColumn("_gone", lit(False)), seen, seen["folders"])
    assert [i for i, *_ in now()] == [1, 3]
