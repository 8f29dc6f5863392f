"""Times of day as whole milliseconds: one parser and one formatter for all notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ms(text: Column, mode: str = "strict") -> Column:
    """``HH:MM:SS[.,]mmm`` as milliseconds.

    ``strict``: null unless that form; ``zero``: zero instead of null; ``lenient``: also ``MM:SS`` and bare seconds.
    """
    t = F.replace(F.trim(text), F.lit(","), F.lit("."))
    parts = F.split(t, ":")
    seconds = lambda c: F.round(c.try_cast("decimal(20,3)") * 1000).cast("long")
    whole = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    full = F.when(F.size(parts) == 3, whole(0) * 3_600_000 + whole(1) * 60_000 + seconds(F.get(parts, F.lit(2))))
    if mode == "strict":
        return F.when(t.rlike(r"^\d{2}:\d{2}:\d{2}(\.\d{1,3})?$"), full)
    if mode == "lenient":
        short = F.when(F.size(parts) == 2, whole(0) * 60_000 + seconds(F.get(parts, F.lit(1)))).when(F.size(parts) == 1, seconds(t))
        return F.coalesce(full, short, F.lit(0))
    return F.coalesce(full, F.lit(0))


def format_ms(ms: Column, style: str = "srt") -> Column:
    """Milliseconds as ``HH:MM:SS,mmm`` (``srt``), ``HH:MM:SS.mmm`` (``dotted``) or ``HH:MM:SS`` (``plain``)."""
    ms = ms.cast("long")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    head = F.concat_ws(":", F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), two(ms / 60_000 % 60), two(ms / 1000 % 60))
    if style == "plain":
        return head
    return F.concat(head, F.lit("," if style == "srt" else "."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def time_range(start: Column, end: Column) -> Column:
    """``start - end`` in dotted notation."""
    return F.concat(format_ms(start, "dotted"), F.lit(" - "), format_ms(end, "dotted"))


def clamp(value: Column, low: Column, high: Column, tolerance: int) -> Column:
    """``value`` moved into [low, high] unless it lies within ``tolerance`` of it."""
    near = (value >= low - tolerance) & (value <= high + tolerance)
    return F.when(near, value).otherwise(F.greatest(low, F.least(high, value)))
