"""Interval algebra over (key, start, end) rows: windows and map-side combined aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sliced(df: DataFrame, start: str, slice_ms: int | None) -> DataFrame:
    return df if slice_ms is None else df.withColumn("_slice", F.floor(F.col(start) / slice_ms))


def _earlier(df: DataFrame, keys: list[str], order: list[str], value: Column, last: bool, slice_ms: int | None, name: str) -> DataFrame:
    """``df`` with the largest (``last``: the latest) ``value`` of the earlier rows of a key.

    With slices a window sees one slice of a key; what the slices before it come to is handed to it, one row a slice.
    """
    pick = (lambda w: F.last(value).over(w)) if last else (lambda w: F.max(value).over(w))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if slice_ms is None:
        return df.withColumn(name, pick(before(Window.partitionBy(*keys).orderBy(*order))))
    whole = F.max_by(value, F.struct(*order)) if last else F.max(value)
    tops = df.groupBy(*keys, "_slice").agg(whole.alias("_top"))
    of = F.last("_top") if last else F.max("_top")
    carried = tops.withColumn("_carry", of.over(before(Window.partitionBy(*keys).orderBy("_slice")))).drop("_top")
    near = pick(before(Window.partitionBy(*keys, "_slice").orderBy(*order)))
    joined = df.join(carried, [*keys, "_slice"])
    return joined.withColumn(name, F.coalesce(near, "_carry") if last else F.greatest(near, "_carry")).drop("_carry")


def _numbered(df: DataFrame, keys: list[str], order: list[str], flag: str, slice_ms: int | None, name: str) -> DataFrame:
    """``df`` with the running sum of ``flag`` within a key."""
    upto = lambda w, k: w.rowsBetween(Window.unboundedPreceding, k)
    if slice_ms is None:
        return df.withColumn(name, F.sum(flag).over(upto(Window.partitionBy(*keys).orderBy(*order), 0)))
    sums = df.groupBy(*keys, "_slice").agg(F.sum(flag).alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(upto(Window.partitionBy(*keys).orderBy("_slice"), -1)), F.lit(0))).drop("_sum")
    run = F.sum(flag).over(upto(Window.partitionBy(*keys, "_slice").orderBy(*order), 0))
    return df.join(sums, [*keys, "_slice"]).withColumn(name, F.col("_base") + run).drop("_base")


def islands(df: DataFrame, keys: list[str], max_gap: int = 0, start: str = "start_ms", end: str = "end_ms", order: list[str] | None = None, slice_ms: int | None = None) -> DataFrame:
    """``df`` with ``island``: a new one begins where a row starts more than ``max_gap`` after all earlier ends.

    ``slice_ms`` cuts keys into slices of time, for tables in which one key may hold a large share of the rows.
    """
    by = [start, end, *(order or [])]
    found = _earlier(_sliced(df, start, slice_ms), keys, by, F.col(end), False, slice_ms, "_reach")
    found = found.withColumn("_fresh", F.when(F.col(start) <= F.col("_reach") + F.lit(max_gap), 0).otherwise(1))
    return _numbered(found, keys, by, "_fresh", slice_ms, "island").drop("_fresh", "_reach", "_slice")


def merge(df: DataFrame, keys: list[str], max_gap: int = 0, start: str = "start_ms", end: str = "end_ms", order: list[str] | None = None, slice_ms: int | None = None) -> DataFrame:
    """Union of intervals of a key; neighbours at most ``max_gap`` apart become one."""
    found = islands(df, keys, max_gap, start, end, order, slice_ms)
    return found.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_segments")).drop("island")


def complement(df: DataFrame, keys: list[str], total: str, start: str = "start_ms", end: str = "end_ms", least: int = 0, slice_ms: int | None = None) -> DataFrame:
    """What the merged intervals of a key leave of [0, ``total``): gaps longer than ``least``, head and tail included."""
    found = _earlier(_sliced(df, start, slice_ms), keys, [start, end], F.col(end), False, slice_ms, "_reach")
    gaps = found.select(*keys, F.coalesce("_reach", F.lit(0)).alias("gap_start"), F.col(start).alias("gap_end"))
    tail = df.groupBy(*keys).agg(F.max(end).alias("gap_start"), F.max(total).alias("gap_end"))
    return gaps.unionByName(tail).where(F.col("gap_end") - F.col("gap_start") > least).select(*keys, F.col("gap_start").alias(start), F.col("gap_end").alias(end))


def pad_without_overlap(df: DataFrame, keys: list[str], buffer: int, order: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Intervals padded by ``buffer`` (not below zero); padded neighbours that overlap meet at their midpoint."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    lo, hi = F.greatest(F.col(start) - buffer, F.lit(0)), F.col(end) + buffer
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    df = df.withColumn("_ph", F.lag("_hi").over(w)).withColumn("_nl", F.lead("_lo").over(w))
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    padded_start = F.when(F.col("_ph") > F.col("_lo"), middle("_ph", "_lo")).otherwise(F.col("_lo"))
    padded_end = F.when(F.col("_nl") < F.col("_hi"), middle("_hi", "_nl")).otherwise(F.col("_hi"))
    return df.withColumn("padded_start", padded_start).withColumn("padded_end", padded_end).drop("_lo", "_hi", "_ph", "_nl")


def fix_overlaps(df: DataFrame, keys: list[str], order: list[str], margin: int = 100, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Neighbours in ``order`` that overlap are both cut at their midpoint, ``margin`` apart; bounds are read first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    pe, ns = F.lag(end).over(w), F.lead(start).over(w)
    df = df.withColumn("_pe", pe).withColumn("_ns", ns)
    fixed_start = F.when(F.col("_pe") > F.col(start), F.floor((F.col("_pe") + F.col(start)) / 2) + margin).otherwise(F.col(start))
    fixed_end = F.when(F.col("_ns") < F.col(end), F.floor((F.col(end) + F.col("_ns")) / 2) - margin).otherwise(F.col(end))
    return df.withColumn("fixed_start", fixed_start).withColumn("fixed_end", fixed_end).drop("_pe", "_ns")


def separate_aligned(df: DataFrame, keys: list[str], order: list[str], step: int = 50) -> DataFrame:
    """Neighbours whose bounds were moved from ``original_start`` and ``original_end``: ``fixed_start``, ``fixed_end``.

    Where the originals leave a gap, no bound moves into it. Neighbours that overlap go back to their originals if that
    parts them, else both end at the middle; bounds that are set anew keep ``step`` off. Done pair after pair this comes to
    the same as at once: a pair moves the end of one and the start of the next, which no other pair reads.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_n", F.struct(F.lag("end_ms").over(w).alias("pe"), F.lag("original_end").over(w).alias("poe"), F.lead("start_ms").over(w).alias("ns"), F.lead("original_start").over(w).alias("nos")))
    pe, poe, ns, nos = (F.col(f"_n.{k}") for k in ("pe", "poe", "ns", "nos"))
    s, e, os, oe = (F.col(k) for k in ("start_ms", "end_ms", "original_start", "original_end"))

    def guarded(end: Column, was_end: Column, start: Column, was_start: Column) -> tuple[Column, Column]:
        gap = was_end < was_start
        return F.when(gap & (end > was_end), was_end).otherwise(end), F.when(gap & (start < was_start), was_start).otherwise(start)

    before_end, own_start = guarded(pe, poe, s, os)
    own_end, next_start = guarded(e, oe, ns, nos)
    parted = lambda end, was_end, start, was_start: F.least(end, was_end) <= F.greatest(start, was_start)
    middle = lambda a, b: F.floor((a + b) / 2)
    start = F.when(own_start < before_end, F.when(parted(before_end, poe, own_start, os), F.greatest(own_start, os)).otherwise(middle(before_end, own_start)) + step)
    start = start.when((poe < os) & (s < os), os + step).otherwise(s)
    end = F.when(next_start < own_end, F.when(parted(own_end, oe, next_start, nos), F.greatest(F.least(own_end, oe) - step, F.lit(0))).otherwise(middle(own_end, next_start) - step))
    end = end.when((oe < nos) & (e > oe), F.greatest(oe - step, F.lit(0))).otherwise(e)
    return df.withColumn("fixed_start", start).withColumn("fixed_end", end).drop("_n")


def duration(start: str = "start_ms", end: str = "end_ms"):
    """Length of an interval, never below zero."""
    return F.greatest(F.lit(0), F.col(end) - F.col(start))


def subtract(segments: DataFrame, removed: DataFrame, keys: list[str], ident: str, width: int, least: int = 0) -> DataFrame:
    """Each segment (``ident``) without the merged removed intervals of its key: pieces longer than ``least``."""
    from spanlake.operators.joins import overlap_join

    left = segments.select(*keys, ident, F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    holes = merge(removed, keys).select(*keys, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    cut = overlap_join(left, holes, keys, width).select(*keys, ident, "l_start", "l_end", F.greatest("l_start", "r_start").alias("a"), F.least("l_end", "r_end").alias("b"))
    bounds = left.select(*keys, ident, "l_start", "l_end", F.col("l_end").alias("a"), F.col("l_end").alias("b"))
    w = Window.partitionBy(*keys, ident).orderBy("a", "b")
    pieces = cut.unionByName(bounds).withColumn("start_ms", F.coalesce(F.lag("b").over(w), F.col("l_start")))
    return pieces.where(F.col("a") - F.col("start_ms") > least).select(*keys, ident, "start_ms", F.col("a").alias("end_ms"), "l_start", "l_end")


def effective(segments: DataFrame, removed: DataFrame, keys: list[str], ident: str, width: int, buffer: int = 200, least: int = 500) -> DataFrame:
    """Each segment without the removed intervals of its key: what is left is padded by ``buffer`` within the segment,
    touching pieces become one, and pieces up to ``least`` go. Segments of a key without removed intervals stay as they are."""
    pieces = subtract(segments, removed, keys, ident, width)
    padded = pieces.withColumn("start_ms", F.greatest("l_start", F.col("start_ms") - buffer)).withColumn("end_ms", F.least("l_end", F.col("end_ms") + buffer))
    cut = removed.where("end_ms > start_ms").select(*keys).distinct()
    kept = merge(padded.join(cut, keys, "left_semi"), [*keys, ident]).where(F.col("end_ms") - F.col("start_ms") > least)
    return kept.select(*keys, ident, "start_ms", "end_ms").unionByName(segments.join(cut, keys, "left_anti").select(*keys, ident, "start_ms", "end_ms"))


def gaps_with_samples(orphans: DataFrame, keys: list[str], max_gap: int, text: str, order: list[str], samples: int = 3, size: int = 40) -> DataFrame:
    """Islands of rows at most ``max_gap`` apart: bounds, ``n`` rows and the beginnings of the first ``samples`` texts."""
    found = islands(orphans, keys, max_gap, order=order)
    found = found.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "island").orderBy("start_ms", "end_ms", *order)))
    first = F.collect_list(F.when((F.col("_k") <= samples) & (F.trim(text) != ""), F.struct("_k", F.left(F.trim(text), F.lit(size)).alias("t"))))
    out = found.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"), F.array_sort(first).alias("s"))
    return out.select(*keys, "start_ms", "end_ms", "n", F.transform("s", lambda x: x["t"]).alias("samples"))


def runs(df: DataFrame, keys: list[str], flag: str, order: list[str]) -> DataFrame:
    """Maximal runs of rows in ``order`` for which ``flag`` holds: ``first_pos``, ``last_pos``, ``n``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = df.withColumn("_pos", F.row_number().over(w)).where(F.col(flag))
    at = at.withColumn("_run", F.col("_pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("_pos")))
    return at.groupBy(*keys, "_run").agg(F.min("_pos").alias("first_pos"), F.max("_pos").alias("last_pos"), F.count("*").alias("n")).drop("_run")


def sessions(df: DataFrame, keys: list[str], gap: int, order: list[str], start: str = "start_ms", end: str = "end_ms", slice_ms: int | None = None) -> DataFrame:
    """``df`` with ``session``: a new one begins where a row starts at least ``gap`` after the row before it ended."""
    by = [start, *order]
    found = _earlier(_sliced(df, start, slice_ms), keys, by, F.col(end), True, slice_ms, "_before")
    found = found.withColumn("_fresh", F.when(F.col(start) - F.col("_before") < gap, 0).otherwise(1))
    return _numbered(found, keys, by, "_fresh", slice_ms, "session").drop("_fresh", "_before", "_slice")
