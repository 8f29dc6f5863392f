"""Subtitle files as a Python data source, batch and stream: ``spark.read.format("subtitles")`` after ``register(spark)``.

Files are cut into byte ranges. A range owns the blocks whose dividing blank lines begin in it (the first range also the
file's first block) and reads on to the end of its last one, so that a file of any size is read by many tasks, each
holding a block and a chunk. Options: ``path`` (a file or folder), ``pattern``, ``range_bytes`` and ``grammar``:

- ``timeline``: three lines or more, the second with two valid time stamps; other blocks are skipped; text lines joined by blanks.
- ``plain``: blocks divided by two line feeds alone, stamps taken as they stand on either side of the arrow, valid or not.
- ``starts``: a number on the first line, the start alone, text lines kept apart.
- ``stamps``: every pair of stamps with commas, wherever it stands, without text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from spanlake.sources.ranges import CHUNK, Window, files_below, ranges_of

SCHEMA = "path string, offset long, seq_num int, start_ms long, end_ms long, start string, end string, text string"
_BLANK = re.compile(rb"\n\s*\n\s*")
_PLAIN = re.compile(rb"\n\n\s*")
_PAIR = re.compile(r"(\d{2}:\d{2}:\d{2}[.,]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[.,]\d{3})")
_COMMAS = re.compile(r"(\d{2}:\d{2}:\d{2},\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2},\d{3})")


def milliseconds(stamp: str) -> int | None:
    m = re.fullmatch(r"(\d{2}):(\d{2}):(\d{2})[.,](\d{3})", stamp)
    return None if m is None else ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int(m[4])


def blocks(path: str, lo: int, hi: int, divider: re.Pattern[bytes] = _BLANK, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the blocks that the range owns."""
    window = Window(path, lo, chunk)
    owned, start = lo == 0, lo
    if not owned:  # white space that began with a line feed before the range is another's
        begin = lo
        while (before := window.back(begin, 256)) and before.isspace():
            begin -= len(before)
        run = before[len(before.rstrip()) :] + window.back(lo, lo - begin)
        while (not window.data or window.data.isspace()) and window.grow():
            pass
        more = len(window.data) - len(window.data.lstrip())
        m = divider.search(run + window.data[:more])
        if m is not None and m.start() < len(run):
            start += more
            window.drop(start)
    while True:
        at = 0
        while (m := divider.search(window.data, at)) is None or m.end() == len(window.data):
            at = max(0, len(window.data.rstrip()) - 1) if m is None else m.start()  # what has been searched can't begin a divider
            if not window.grow():
                break
        if owned and (text := (window.data if m is None else window.data[: m.start()])).strip():
            yield start, text
        if m is None or window.base + m.start() >= hi or m.end() == len(window.data):
            return
        owned, start = True, window.base + m.end()
        window.drop(start)


def captions(grammar: str, block: bytes) -> Iterator[tuple]:
    """(seq_num, start_ms, end_ms, start, end, text) of a block."""
    text = block.decode("utf-8", "replace").replace("\r", "").removeprefix("﻿").strip()
    if grammar == "stamps":
        for a, b in _COMMAS.findall(text):
            yield None, milliseconds(a), milliseconds(b), a, b, None
        return
    lines = text.split("\n")
    number = int(lines[0]) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", lines[0]) else None
    if len(lines) < 3:
        return
    if grammar == "timeline":
        if m := _PAIR.match(lines[1]):
            yield number, milliseconds(m[1]), milliseconds(m[2]), m[1], m[2], " ".join(lines[2:]).strip()
    elif grammar == "plain":
        if " --> " in lines[1]:
            a, b = lines[1].split(" --> ")[:2]
            yield number, milliseconds(a), milliseconds(b), a, b, " ".join(lines[2:])
    elif number is not None:
        a = lines[1].split(" --> ")[0]
        yield number, milliseconds(a), None, a, None, "\n".join(lines[2:])


class Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int) -> None:
        self.path, self.lo, self.hi = path, lo, hi


class _Ranges:
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.width, self.grammar = int(options.get("range_bytes", 64 << 20)), options.get("grammar", "timeline")
        if self.grammar not in ("timeline", "plain", "starts", "stamps"):
            raise ValueError(f"unknown grammar {self.grammar}")

    def read(self, partition: Range) -> Iterator[tuple]:
        for offset, block in blocks(partition.path, partition.lo, partition.hi, _PLAIN if self.grammar == "plain" else _BLANK):
            for found in captions(self.grammar, block):
                yield (partition.path, offset, *found)


class Batch(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [Range(path, *r) for path, size, _ in files_below(self.path, self.pattern) for r in ranges_of(size, self.width)]


class Stream(_Ranges, DataSourceStreamReader):
    """Files as they come: an offset is the time and name of the last file taken, so it stays small."""

    def initialOffset(self) -> dict:
        return {"ns": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((ns, path) for path, _, ns in files_below(self.path, self.pattern)), default=(-1, ""))
        return {"ns": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        lo, hi = (start["ns"], start["path"]), (end["ns"], end["path"])
        return [Range(path, *r) for path, size, ns in files_below(self.path, self.pattern) if lo < (ns, path) <= hi for r in ranges_of(size, self.width)]

    def commit(self, end: dict) -> None:
        pass


class Subtitles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Subtitles)
