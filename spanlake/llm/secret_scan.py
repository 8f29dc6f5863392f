"""Secrets in texts: fixed formats, and high-entropy windows over candidate strings.

Candidates are maximal runs of token characters. A window of fixed width slides over each and is judged by the class of
its own characters, so that a key keeps its class beside words; the sum of ``c * log2(c)`` over the window's character counts changes by the two characters that leave and
enter, which gives every window's Shannon entropy in constant time. Windows of many candidates are processed together: long
candidates are cut into stretches that overlap by a window less one character, and a step of the slide is one numpy
operation over all stretches of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import slices, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
#: Character classes: the window's width and the least entropy in bits. Candidates are at least as long as a window.
CLASSES = {"entropy_hex": (20, 3.0), "entropy_base32": (20, 3.4), "entropy_base64": (20, 3.9)}
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{min(w for w, _ in CLASSES.values())},}}={{0,2}}")
#: Windows of a stretch.
STRETCH = 256
_DELIMITERS, _SEGMENT, _DELIMITER = frozenset("+/_=-"), re.compile(r"[^+/_=-]+"), re.compile(r"[+/_=-]")
_RUN_BEFORE, _RUN_AFTER = re.compile(r"[A-Za-z0-9+/_-]+\Z"), re.compile(r"[A-Za-z0-9+/_-]*")
#: Characters of the narrower classes, in their order; a window that has others is of the last class.
_NARROW = [np.array([chr(c) in chars for c in range(128)]) for chars in ("0123456789abcdefABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789=")]
_WORD = re.compile(r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)[0-9]{0,2}|[0-9]{1,4}")
#: Strings that look random and are none: example keys, UUIDs, dotted or slashed paths of words, counters, placeholders.
#: A pattern covers the characters that it matches, in a candidate or in one of its segments, and no others.
ALLOWED = (
    r"EXAMPLE|example|placeholder|changeme|dummy|sample",
    r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z",
    r"\A[A-Za-z]+(?:[-_/=+][A-Za-z]+)*[-_/=+]?[0-9]{0,4}\Z",
    r"\A[0-9+/_=-]+\Z",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
)


def entropies(strings: list[str], width: int) -> list[np.ndarray]:
    """Shannon entropy in bits of every window of ``width`` characters of each string (at least that long)."""
    windows = [len(s) - width + 1 for s in strings]
    parts = [s[k : k + STRETCH + width - 1] for s, n in zip(strings, windows, strict=True) for k in range(0, n, STRETCH)]
    lengths = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    codes = np.zeros((len(parts), longest), np.uint8)
    for row, i in enumerate(order):
        codes[row, : lengths[i]] = np.frombuffer(parts[i].encode("ascii"), np.uint8)
    term = np.arange(width + 2) * np.log2(np.maximum(np.arange(width + 2), 1))
    counts = np.zeros((len(parts), 128), np.int16)
    total = np.zeros(len(parts))
    out = np.zeros((len(parts), max(longest - width + 1, 0)))
    rows = np.arange(len(parts))
    alive = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), side="right")  # stretches that reach so far
    for k in range(longest):
        live = rows[: alive[k]]
        come = codes[live, k]
        c = counts[live, come]
        total[live] += term[c + 1] - term[c]
        counts[live, come] = c + 1
        if k >= width:
            go = codes[live, k - width]
            c = counts[live, go]
            total[live] += term[c - 1] - term[c]
            counts[live, go] = c - 1
        if k >= width - 1:
            out[live, k - width + 1] = np.log2(width) - total[live] / width
    back = np.empty(len(parts), np.int64)
    back[order] = rows
    found, at = [], 0
    for n in windows:
        own = back[at : at - (-n // STRETCH)]
        found.append(out[own].ravel()[:n] if len(own) > 1 else out[own[0], :n])
        at += len(own)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats in order; positions are code points, ends exclusive."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append((m.start(), 0, m.end()))
    found.extend((m.start(), 1, m.end()) for m in ACCESS.finditer(text))
    found.extend((m.start(), 2, m.end()) for m in HEX.finditer(text))
    return sorted(found)


def _classes_of(s: str, width: int) -> np.ndarray:
    """The class of every window of ``width`` characters, by its number."""
    codes = np.frombuffer(s.encode("ascii"), np.uint8)
    kinds = np.full(len(s) - width + 1, len(_NARROW))
    for k in reversed(range(len(_NARROW))):
        others = np.concatenate([[0], np.cumsum(~_NARROW[k][codes])])
        kinds[others[width:] == others[:-width]] = k
    return kinds


def _uncovered(s: str, allowed: list[re.Pattern[str]]) -> np.ndarray | None:
    """Sums of the characters before each place of a candidate that no allowed pattern covers; None if all are covered.

    Delimiters between segments count as covered.
    """
    left = np.array([c not in _DELIMITERS for c in s])
    parts = [(0, s)] + ([(m.start(), m.group()) for m in _SEGMENT.finditer(s)] if not left.all() else [])
    for start, part in parts:
        for pattern in allowed:
            for m in pattern.finditer(part):
                left[start + m.start() : start + m.end()] = False
    return np.concatenate([[0], np.cumsum(left)]) if left.any() else None


def entropy_spans(texts: list[str], allowed: list[re.Pattern[str]]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) for each text: unions of the windows whose entropy reaches the bound of their own class.

    A window whose characters are all covered by allowed patterns is passed over; the rest of its candidate is not. Windows that
    meet make one span, of the class that most of them have (the narrower one of equals).
    """
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    found = [(i, m.start(), m.group()) for i, t in enumerate(texts) for m in _CANDIDATE.finditer(t)]
    group = [(i, start, s, left) for i, start, s in found if (left := _uncovered(s, allowed)) is not None]
    names, at = list(CLASSES), 0
    while at < len(group):  # about a million characters at once
        ends = np.cumsum([len(g[2]) for g in group[at : at + 4096]])
        part = group[at : at + max(1, int(np.searchsorted(ends, 1_000_000, side="right")))]
        at += len(part)
        high: list[list[tuple[int, int, int]]] = [[] for _ in part]
        for width in sorted({w for w, _ in CLASSES.values()}):
            fit = [n for n, g in enumerate(part) if len(g[2]) >= width]
            bounds = np.array([b if w == width else np.inf for w, b in CLASSES.values()])
            for n, h in zip(fit, entropies([part[n][2] for n in fit], width), strict=True):
                _, _, s, left = part[n]
                if h.max() >= bounds.min() - 1e-9:
                    kinds = _classes_of(s, width)
                    hits = np.flatnonzero((h >= bounds[kinds] - 1e-9) & (left[width:] > left[:-width]))
                    high[n].extend((int(a), int(a) + width, int(kinds[a])) for a in hits)
        for (i, start, _, _), windows in zip(part, high, strict=True):
            span: list[int] = []
            votes = np.zeros(len(names), np.int64)
            for a, b, k in [*sorted(windows), (1 << 60, 0, 0)]:
                if span and a > span[1]:
                    out[i].append((start + span[0], start + span[1], names[int(votes.argmax())]))
                    span, votes = [], np.zeros(len(names), np.int64)
                span = [span[0], max(span[1], b)] if span else [a, b]
                votes[k] += 1
    return out


def whole_keys(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What is to be taken out of a text for its spans: sorted (start, end), none overlapping.

    A span of a key goes on to the ends of the segments between delimiters that it touches (words of the same run within a
    window of the key go with it), and over segments beside them that don't look like a word or a small number.
    """
    out: list[tuple[int, int]] = []
    for a, b, kind in sorted(spans):
        if kind != "assign":
            lo = next((m.start() for m in [_RUN_BEFORE.search(text, max(0, a - 4096), a)] if m), a)
            hi = _RUN_AFTER.match(text, b).end()
            cuts = [lo, *(lo + m.start() for m in _DELIMITER.finditer(text[lo:hi])), hi]
            first = max((k for k, c in enumerate(cuts[:-1]) if c <= a), default=0)
            last = next(k for k, c in enumerate(cuts) if c >= b and k > first)
            segment = lambda k: text[cuts[k] : cuts[k + 1]].strip("+/_=-")  # noqa: B023, E731
            while first > 0 and segment(first - 1) and not _WORD.fullmatch(segment(first - 1)):
                first -= 1
            while last < len(cuts) - 1 and segment(last) and not _WORD.fullmatch(segment(last)):
                last += 1
            a = cuts[first] + (first > 0 and cuts[first] < a)  # the delimiter before a key stays
            b = max(b, cuts[last])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_secrets(texts: list[str], allow: tuple[str, ...] = ALLOWED) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For each text its base spans and all spans, as (start, end, kind) in order of start, then kind."""
    allowed = [re.compile(x) for x in allow]
    order = {k: i for i, k in enumerate((*BASE_KINDS, *CLASSES))}
    out = []
    for text, more in zip(texts, entropy_spans(texts, allowed), strict=True):
        base = [(s, e, BASE_KINDS[k]) for s, k, e in base_spans(text)]
        spans = sorted([*base, *more], key=lambda x: (x[0], order[x[2]], x[1])) if more else base
        out.append((base, spans))
    return out


_SPANS = "array<struct<kind: string, start: int, end: int>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` (spans of fixed formats) and ``spans`` (those and the method's).

    Base spans are never suppressed; ``allow`` lists patterns of strings that the entropy test passes over, which are
    looked for in candidates and in their segments between delimiters. A null or empty text has no spans. Repeated and null ids are kept as they are; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = find_secrets([(b or b"").decode("utf-8", "replace") for b in batch.column(1).to_pylist()], allow)
            spans = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f[j]] for f in found], _TYPE) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *spans], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` (overlapping ones by one mark); all rows and columns stay.

    A key goes whole: its span is carried on to the ends of its segments (``whole_keys``). An empty table gives an empty one.

    A null text stays null. A text without secrets stays as it is; of one with secrets, bytes that are no UTF-8 become
    replacement characters.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])  # whatever the columns are called
    schema = rows.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            kind = batch.schema.field(at).type
            raw = batch.column(at).cast(pa.large_binary()).to_pylist()
            out = list(raw)
            for i, (_, spans) in enumerate(find_secrets([(t or b"").decode("utf-8", "replace") for t in raw], allow)):
                if spans:
                    text, parts, end = raw[i].decode("utf-8", "replace"), [], 0
                    for s, e in whole_keys(text, spans):
                        parts += [text[end:s], mark]
                        end = e
                    out[i] = "".join([*parts, text[end:]]).encode()
            texts = pa.array(out, pa.large_binary() if pa.types.is_large_string(kind) else pa.binary())
            yield batch.set_column(at, batch.schema.field(at), pa.Array.from_buffers(kind, len(texts), texts.buffers()))

    return small_batches(rows).mapInArrow(run, schema).toDF(*names)
