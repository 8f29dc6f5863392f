"""Objects of JSON arrays in files of any size, read by byte ranges.

Whether a byte range begins inside a string, and how deep, depends on all that comes before it. One pass gives for each
range, for either beginning, how the depth changes and whether it ends in a string; the driver chains these (a few
numbers a range). With its beginning known, each range then finds the objects that begin in it and reads on to the end of
its last one; nothing holds a file. For a wrapper another pass looks for its keys, which lie above the objects.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.sources.ranges import CHUNK, Window, files_below, ranges_of

_QUOTE, _SLASH = ord('"'), ord("\\")
#: Bytes that are read at least at a time, and that a task reads at least if there are many.
_LEAST, _TASK = 4096, 16 << 20
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


def _escapes(window: Window, lo: int) -> int:
    """How many backslashes stand right before ``lo``."""
    n, at = 0, lo
    while (before := window.back(at, 256)) and n == lo - at:
        n += len(before) - len(before.rstrip(b"\\"))
        at -= len(before)
    return n


def structure(data: bytes, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(which bytes are structural quotes or lie outside strings, steps of the depth, inside and escaped at the end).

    ``escaped``: the first byte is escaped by a backslash before it, should it lie in a string.
    """
    raw = np.frombuffer(data, np.uint8)
    slash = raw == _SLASH
    # a byte is escaped if an odd number of backslashes stands before it
    last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw)))) if len(raw) else np.empty(0, np.int64)
    run = np.concatenate([[0], (np.arange(len(raw)) - last)[:-1]]) if len(raw) else last
    lead = np.concatenate([[True], (last == -1)[:-1]]) if len(raw) else slash
    odd = (run + (lead & escaped)) % 2 == 1
    quote = (raw == _QUOTE) & ~odd
    within = (np.cumsum(quote) + inside) % 2 == 1  # from a string's opening quote up to its last byte
    step = np.where(within | quote, 0, _STEP[raw])
    n = (len(raw) - 1 - last[-1]) if len(raw) else 0
    tail = bool((n + (escaped and last[-1] == -1)) % 2) if len(raw) else escaped
    return quote, step, bool(within[-1]) if len(raw) else inside, tail


def _chunks(path: str, lo: int, hi: int, chunk: int) -> Iterator[tuple[int, bytes]]:
    window = Window(path, lo, chunk)
    while window.base < hi and window.grow():
        data = window.data[: hi - window.base]
        yield window.base, data
        window.drop(window.base + len(data))


def summary(path: str, lo: int, hi: int, chunk: int = CHUNK) -> list[tuple[int, bool]]:
    """(change of depth, ends in a string) if the range begins outside a string, and if it begins in one."""
    odd = _escapes(Window(path, lo, chunk), lo) % 2 == 1
    out = []
    for inside in (False, True):
        depth, now, escaped = 0, inside, odd and inside
        for _, data in _chunks(path, lo, hi, chunk):
            _, step, now, escaped = structure(data, now, escaped)
            depth += int(step.sum())
        out.append((depth, now))
    return out


def events(path: str, lo: int, hi: int, depth: int, inside: bool, at: int, chunk: int = CHUNK) -> Iterator[tuple[int, str]]:
    """(offset, byte) of the quotes and brackets at depth ``at``: brackets by the depth outside them."""
    escaped = inside and _escapes(Window(path, lo, chunk), lo) % 2 == 1
    for base, data in _chunks(path, lo, hi, chunk):
        quote, step, after, tail = structure(data, inside, escaped)
        level = depth + np.cumsum(step) - np.maximum(step, 0)
        for k in np.flatnonzero((quote | (step != 0)) & (level == at)):
            yield base + int(k), chr(data[k])
        depth, inside, escaped = depth + int(step.sum()), after, tail


def objects(path: str, lo: int, hi: int, depth: int, inside: bool, at: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the objects that begin in the range at depth ``at``."""
    escaped = inside and _escapes(Window(path, lo, chunk), lo) % 2 == 1
    parts: list[bytes] = []  # of an object whose end has not come yet
    begin = None
    for base, data in _chunks(path, lo, 1 << 62, min(chunk, max(hi - lo, _LEAST))):  # what lies behind the range is read only as far as needed
        _, step, after, tail = structure(data, inside, escaped)
        level = depth + np.cumsum(step)
        raw = np.frombuffer(data, np.uint8)
        marks = np.flatnonzero(((step == 1) & (level == at + 1) & (raw == ord("{"))) | ((step == -1) & (level == at) & (raw == ord("}"))))
        done = 0
        for k in marks:
            if step[k] == 1:
                if base + int(k) >= hi:
                    return
                begin, done, parts = base + int(k), int(k), []
            elif begin is not None:
                yield begin, b"".join([*parts, data[done : int(k) + 1]])
                begin, parts = None, []
        if begin is not None:
            parts.append(data[done:])
        depth, inside, escaped = int(level[-1]), after, tail
        if begin is None and base + len(data) >= hi:
            return


def under(found: list[tuple[int, str]], path: str, key: str, bracket: str) -> tuple[int, int] | None:
    """Where the value of ``key`` begins and ends, if it opens with ``bracket``, from the events of an object in order."""
    name, quotes = key.encode(), [o for o, c in found if c == '"']
    for a, b in zip(quotes[::2], quotes[1::2], strict=False):
        if b - a - 1 == len(name) and Window(path, a + 1).file.read_at(len(name), a + 1) == name:
            rest = [e for e in found if e[0] > b and e[1] in "[]{}"][:2]
            if rest and rest[0][1] == bracket and Window(path, b).file.read_at(min(rest[0][0] - b - 1, 4096), b + 1).strip() == b":":
                return rest[0][0], rest[1][0] if len(rest) > 1 else 1 << 62
    return None


def read(spark: SparkSession, path: str, schema: str, keys: Sequence[Sequence[str]] = ((),), pattern: str = "*.json", width: int = 64 << 20) -> DataFrame:
    """``path``, ``offset`` and the columns of ``schema`` of every object of an array in a file, or in the files below a folder.

    ``keys``: where the array may lie, in order of preference: ``()`` for the file itself, ``("clips",)`` or ``("data", "clips")`` under
    keys of a wrapper. The first that a file has counts; a file without any gives nothing.
    """
    listed = [(p, *r) for p, size, _ in files_below(path, pattern) for r in ranges_of(size, width)]
    if not listed:
        raise FileNotFoundError(f"{path} {pattern}")
    # small files and small ranges share tasks
    tasks = lambda n: max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, sum(hi - lo for _, lo, hi in listed) // max(width, _TASK))))
    parts = spark.createDataFrame(listed, "path string, lo long, hi long").repartition(tasks(len(listed)), "path", "lo")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (a, x), (b, y) = summary(r["path"], r["lo"], r["hi"])
                top = next(events(r["path"], 0, r["hi"], 0, False, 0), None) if r["lo"] == 0 else None
                yield pa.RecordBatch.from_pylist([r | {"a": a, "x": x, "b": b, "y": y, "first": top and top[0], "top": top and top[1]}], schema=columns)

    columns = pa.schema([("path", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("a", pa.int64()), ("x", pa.bool_()), ("b", pa.int64()), ("y", pa.bool_()), ("first", pa.int64()), ("top", pa.string())])
    known, tops, depth, inside = [], {}, 0, False
    for r in sorted(parts.mapInArrow(summed, "path string, lo long, hi long, a long, x boolean, b long, y boolean, first long, top string").collect(), key=lambda r: (r.path, r.lo)):  # a row a range
        if r.lo == 0:
            depth, inside, tops[r.path] = 0, False, (r.top, r.first)
        known.append((r.path, r.lo, r.hi, depth, inside))
        change, inside = (r.b, r.y) if inside else (r.a, r.x)
        depth += change

    def noted(level: int, within: dict[str, tuple[int, int]]) -> dict[str, list[tuple[int, str]]]:
        """Events of the objects at ``within``, which are at a level: a wrapper's own keys and values."""
        rows = [(p, lo, hi, d, i, *within[p]) for p, lo, hi, d, i in known if p in within and lo < within[p][1] and hi > within[p][0]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    own = [{"path": r["path"], "offset": o, "mark": c} for o, c in events(r["path"], r["lo"], r["hi"], r["depth"], r["inside"], level) if r["a"] < o < r["b"]]
                    yield pa.RecordBatch.from_pylist(own, schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("mark", pa.string())]))

        df = spark.createDataFrame(rows, "path string, lo long, hi long, depth long, inside boolean, a long, b long").repartition(tasks(len(rows)), "path", "lo")
        by: dict[str, list[tuple[int, str]]] = {}
        for r in sorted(df.mapInArrow(run, "path string, offset long, mark string").collect()):
            by.setdefault(r.path, []).append((r.offset, r.mark))
        return by

    spots: dict[str, tuple[int, int, int]] = {}
    for option in keys:
        if not option:
            spots |= {p: (first, 1 << 62, 1) for p, (top, first) in tops.items() if top == "[" and p not in spots}
        within = {p: (first, 1 << 62) for p, (top, first) in tops.items() if option and top == "{" and p not in spots}
        for level, key in enumerate(option, 1):
            found = noted(level, within) if within else {}
            hits = {p: under(e, p, key, "[" if level == len(option) else "{") for p, e in found.items()}
            within = {p: hit for p, hit in hits.items() if hit is not None}
        spots |= {p: (*hit, len(option) + 1) for p, hit in within.items()}
    wanted = [(p, max(lo, spots[p][0]), min(hi, spots[p][1]), lo, d, i, spots[p][2]) for p, lo, hi, d, i in known if p in spots and lo < spots[p][1] and hi > spots[p][0]]
    last = spark.createDataFrame(wanted, "path string, a long, b long, lo long, depth long, inside boolean, at long").repartition(tasks(len(wanted)), "path", "lo")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("value", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                lot, size = [], 0
                for offset, text in objects(r["path"], r["lo"], r["b"], r["depth"], r["inside"], r["at"]):
                    if offset >= r["a"]:
                        lot.append({"path": r["path"], "offset": offset, "value": text.decode("utf-8", "replace")})
                        size += len(text)
                    if size > CHUNK:
                        yield pa.RecordBatch.from_pylist(lot, columns)
                        lot, size = [], 0
                yield pa.RecordBatch.from_pylist(lot, columns)

    values = last.mapInArrow(cut, "path string, offset long, value string")
    return values.withColumn("value", F.from_json("value", schema)).select("path", "offset", "value.*")
