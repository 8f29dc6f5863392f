"""Segments of clips held against the captions of their medium, and topics whose bounds grow one after another.

Captions have ``pos`` (their order in the medium), ``seq`` (their number, which may jump), ``r_start``, ``r_end`` and flags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators import intervals
from spanlake.operators.joins import going, overlap_join
from spanlake.storage import checkpoints


def snapped(segments: DataFrame, captions: DataFrame, keys: list[str], own: list[str], width: int, silence: int, tail: int, voiceless: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments cut to their captions, and the sections that are to be removed from them.

    A segment (``own`` columns, ``l_start``, ``l_end``) has the captions that lie in it, or those that overlap it if none
    does. It then runs from the first one's start to the last one's end, but ends where their numbers jump for the last time, and before
    the last caption if that follows after more than ``tail`` and more than half of ``silence``. Gaps of more than
    ``silence`` between its captions are to be removed. One without captions is to be removed whole, unless ``voiceless``
    (``r_start``, ``r_end``) is given and no such interval overlaps it: it then stays, with ``low_confidence``.
    """
    checkpoints(segments.sparkSession)
    met = overlap_join(segments, captions.select(*keys, "pos", "seq", "r_start", "r_end"), keys, width, longest=width)
    met = met.withColumn("_in", (F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end")))
    met = met.withColumn("_any", F.max("_in").over(Window.partitionBy(*keys, *own))).where("_in or not _any")
    w = Window.partitionBy(*keys, *own).orderBy("pos")
    met = met.withColumn("_before", F.lag("r_end").over(w)).withColumn("_jump", F.col("seq") - F.lag("seq").over(w) > 1)
    gap = F.when(F.col("r_start") - F.col("_before") > silence, F.struct(F.col("_before").alias("start_ms"), F.col("r_start").alias("end_ms")))
    met = met.groupBy(*keys, *own, "l_start", "l_end").agg(
        F.min_by("r_start", "pos").alias("start_ms"), F.max_by("r_end", "pos").alias("_end"), F.max_by("_before", F.when(F.col("_jump"), F.col("pos"))).alias("_cut"),
        F.max_by(F.struct((F.col("r_start") - F.col("_before")).alias("gap"), F.col("_before").alias("at")), "pos").alias("_tail"), F.collect_list(gap).alias("_gaps"),
    ).checkpoint()
    late = F.when((F.col("_tail.gap") > tail) & (2 * F.col("_tail.gap") > silence), F.col("_tail.at"))
    found = met.select(*keys, *own, "start_ms", F.least("_end", "_cut", late).alias("end_ms"), F.lit(False).alias("low_confidence"))
    gaps = met.select(*keys, *own, F.inline("_gaps")).withColumn("reason", F.lit("gap"))
    bare = segments.join(found.select(*keys, *own), [*keys, *own], "left_anti")
    if voiceless is not None:
        quiet = overlap_join(bare, voiceless.select(*keys, "r_start", "r_end"), keys, width, longest=width).select(*keys, *own).distinct()
        heard = bare.join(quiet, [*keys, *own], "left_anti").select(*keys, *own, F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms"), F.lit(True).alias("low_confidence"))
        found, bare = found.unionByName(heard), bare.join(quiet, [*keys, *own], "left_semi")
    removed = gaps.unionByName(bare.select(*keys, *own, F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms"), F.lit("no captions").alias("reason")))
    return found, removed


def joined_neighbours(segments: DataFrame, captions: DataFrame, keys: list[str], clip: list[str], width: int, near: int, on: int, far: int, short: int) -> DataFrame:
    """Segments of a clip united where they overlap, and with the next one where the gap between them asks for it.

    A gap without captions closes up to ``near``; one with captions up to ``on`` if each ``continues`` or lasts at most
    ``short``, and up to ``far`` if one of them has a ``hit``. Each gap is judged by the bounds beside it alone.
    """
    whole = intervals.merge(segments.select(*keys, *clip, "start_ms", "end_ms"), [*keys, *clip]).drop("n_segments")
    w = Window.partitionBy(*keys, *clip).orderBy("start_ms")
    whole = whole.withColumn("_pe", F.lag("end_ms").over(w))
    gap = F.col("start_ms") - F.col("_pe")
    gaps = whole.where(gap <= max(near, on, far)).select(*keys, *clip, F.col("start_ms").alias("_at"), F.col("_pe").alias("l_start"), F.col("start_ms").alias("l_end"))
    flags = captions.select(*keys, "r_start", "r_end", "hit", (F.col("continues") | (F.col("r_end") - F.col("r_start") <= short)).alias("_on"))
    inside = overlap_join(gaps, flags, keys, width, how="within", longest=width).groupBy(*keys, *clip, F.col("_at").alias("start_ms")).agg(F.bool_or("hit").alias("_hit"), F.bool_and("_on").alias("_all"))
    closes = F.when(F.col("_all").isNull(), gap <= near).when(gap > on, (gap <= far) & F.col("_hit")).otherwise(F.col("_all"))
    both = whole.join(inside, [*keys, *clip, "start_ms"], "left").withColumn("_new", F.when(F.coalesce(closes, F.lit(False)), 0).otherwise(1))
    both = both.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return both.groupBy(*keys, *clip, "_group").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_group")


def run_on(segments: DataFrame, captions: DataFrame, keys: list[str], own: list[str], width: int, short: int, slice_ms: int | None = None) -> DataFrame:
    """Segments whose ends move on over the captions after them as long as each continues the one before it.

    A caption continues if it ``leads_on``, lasts at most ``short``, or follows one that doesn't end a sentence (``ends``).
    That depends on neighbours alone, so a medium's captions fall into chains, and a segment that ends in a chain ends
    with it. The last caption in the segment counts, or else the first that overlaps it.
    """
    caps = captions.select(*keys, "pos", "r_start", "r_end", "leads_on", "ends").withColumn("_at", F.col("r_start"))
    sliced = intervals._sliced(caps, "_at", slice_ms)
    sliced = intervals._earlier(sliced, keys, ["_at", "pos"], F.struct("ends"), True, slice_ms, "_prev")
    on = F.col("leads_on") | (F.col("r_end") - F.col("r_start") <= short) | ~F.col("_prev.ends")
    sliced = sliced.withColumn("_fresh", F.when(F.col("_prev").isNotNull() & on, 0).otherwise(1))
    chained = intervals._numbered(sliced, keys, ["_at", "pos"], "_fresh", slice_ms, "_chain")
    last = chained.groupBy(*keys, "_chain").agg(F.max(F.struct("pos", F.col("r_end").alias("to"))).alias("_last"))
    rows = segments.withColumn("l_start", F.col("start_ms")).withColumn("l_end", F.col("end_ms"))
    met = overlap_join(rows.select(*keys, *own, "l_start", "l_end"), chained.select(*keys, "pos", "_chain", "r_start", "r_end"), keys, width, longest=width)
    inside = (F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end"))
    here = F.struct("pos", "_chain")
    at = met.groupBy(*keys, *own, "l_start", "l_end").agg(F.coalesce(F.max(F.when(inside, here)), F.min(here)).alias("_here")).withColumn("_chain", F.col("_here._chain"))
    moved = at.join(last, [*keys, "_chain"]).where("_last.pos > _here.pos").select(*keys, *own, F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms"), F.col("_last.to").alias("_to"))
    return segments.join(moved, [*keys, *own, "start_ms", "end_ms"], "left").withColumn("end_ms", F.coalesce("_to", "end_ms")).drop("_to")


def validate(segments: DataFrame, captions: DataFrame, keys: list[str], clip: str, ident: str, width: int, silence: int, tail: int, near: int, on: int, far: int, short: int,
             voiceless: DataFrame | None = None, slice_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, sections to remove) of each clip: snapped, joined with their neighbours and run on.

    A clip none of whose segments has captions keeps them as they are. Sections are listed once.
    """
    checkpoints(segments.sparkSession)
    segments, captions = segments.checkpoint(), captions.checkpoint()  # each is read by several steps
    found, removed = snapped(segments, captions, keys, [clip, ident], width, silence, tail, voiceless)
    found = found.checkpoint()
    kept = run_on(joined_neighbours(found, captions, keys, [clip], width, near, on, far, short), captions, keys, [clip], width, short, slice_ms)
    rest = segments.join(found.select(*keys, clip).distinct(), [*keys, clip], "left_anti").select(*keys, clip, F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms"))
    return kept.select(*keys, clip, "start_ms", "end_ms").unionByName(rest).checkpoint(), removed.select(*keys, clip, "start_ms", "end_ms", "reason").distinct()


def sections(segments: DataFrame, captions: DataFrame, keys: list[str], clip: str, ident: str, width: int, silence: int, tail: int, voiceless: DataFrame | None = None) -> DataFrame:
    """The sections to remove that ``validate`` gives, where its segments aren't asked for: they depend on the first step alone."""
    removed = snapped(segments, captions, keys, [clip, ident], width, silence, tail, voiceless)[1]
    return removed.select(*keys, clip, "start_ms", "end_ms", "reason").distinct()


def backfill_in_turn(topics: DataFrame, captions: DataFrame, keys: list[str], ident: str, width: int, back: int, forward: int, margin: int) -> DataFrame:
    """``keys, ident, segments`` (sorted, of ``start_ms`` and ``end_ms``) of topics whose first start and last end grow, in order of ``ident``.

    ``topics`` has a row a segment (``l_start``, ``l_end``). Captions have the flags ``depends``, ``switches``, ``ends`` and
    ``continues``. The first segment begins earlier, by at most ``back``, if its first caption depends on what came before; the last one
    ends up to ``forward`` captions later, as long as sentences go on and the topic doesn't switch. A step that reaches more than
    ``margin`` into a segment of another topic isn't taken, and the others are as their own turn has left them. Only
    topics that could meet matter to each other: a medium falls into chains of such topics, and each is run through on its own.
    """
    seg = F.array_sort(F.collect_list(F.struct(F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms"))))
    whole = topics.groupBy(*keys, ident).agg(seg.alias("segments"))
    w = Window.partitionBy(*keys).orderBy("pos")
    before = F.coalesce(F.lag("ends").over(w), F.lit(True))
    # a way back stops at a caption that switches, or that depends on nothing and follows the end of a sentence
    caps = captions.withColumn("_stop", F.col("switches") | (before & ~F.col("depends"))).withColumn("_goes", ~((before & ~F.col("continues")) | F.col("switches")))
    caps = caps.withColumn("_way", F.sum(F.col("_stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    checkpoints(topics.sparkSession)
    # one that stops is the first of its way; of the captions after one only the ends up to the first that doesn't go on are kept
    after = F.collect_list(F.struct("_goes", F.col("r_end").alias("to"))).over(w.rowsBetween(1, forward))
    caps = caps.select(
        *keys, "pos", "r_start", "r_end", "_way", F.coalesce(F.col("depends") & ~F.col("_stop"), F.lit(False)).alias("_back"), (F.lead("_way").over(w) == F.col("_way")).alias("_more"), going(after).alias("_to")
    ).checkpoint()
    bounds = lambda s: [F.col(s)["start_ms"].alias("l_start"), F.col(s)["end_ms"].alias("l_end")]
    tops = whole.withColumn("_a", F.element_at("segments", 1)).withColumn("_z", F.element_at("segments", -1)).checkpoint()

    def met(rows: DataFrame, *told: str) -> DataFrame:
        pairs = overlap_join(rows, caps.select(*keys, "pos", *told, "r_start", "r_end"), keys, width, longest=width)
        return pairs.withColumn("_in", (F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end")))

    what = F.struct("pos", "_way", "_back")
    first = met(tops.select(*keys, ident, *bounds("_a")), "_way", "_back").groupBy(*keys, ident, "l_start").agg(F.min_by(what, F.struct((~F.col("_in")).alias("o"), "pos")).alias("_first"))
    reach = first.where("_first._back").select(*keys, ident, "_first._way", F.col("_first.pos").alias("_pos"), F.col("l_start").alias("_was"), F.greatest(F.lit(0), F.col("l_start") - back).alias("l_start"), F.col("l_start").alias("l_end"))
    points = caps.where("_more").select(*keys, "_way", "pos", "r_start", F.col("r_start").alias("r_end"))  # those that another one of their way follows
    earlier = overlap_join(reach, points, [*keys, "_way"], width, how="within", longest=width).where("pos < _pos").groupBy(*keys, ident, "_was").agg(F.min("r_start").alias("_start"))
    earlier = earlier.where("_start < _was").select(*keys, ident, "_start")
    tops = tops.join(earlier, [*keys, ident], "left").checkpoint()
    # the last caption of the last segment as it is, and with the new start where that is its own: there is one segment
    moved = (F.size("segments") == 1) & F.col("_start").isNotNull()
    was, now = F.struct(F.lit(0).alias("v"), F.col("_z")["start_ms"].alias("s")), F.struct(F.lit(1).alias("v"), F.col("_start").alias("s"))
    both = tops.select(*keys, ident, F.explode(F.when(moved, F.array(was, now)).otherwise(F.array(was))).alias("x"), F.col("_z")["end_ms"].alias("l_end"))
    last = met(both.select(*keys, ident, F.col("x.v").alias("_v"), F.col("x.s").alias("l_start"), "l_end"), "_to").groupBy(*keys, ident).agg(
        *[F.max_by("_to", F.when(F.col("_v") == v, F.struct("_in", "pos"))).alias(f"_n{v}") for v in (0, 1)]
    )
    tops = tops.join(last, [*keys, ident], "left")
    none = F.array().cast("array<bigint>")
    tops = tops.select(*keys, ident, "segments", "_start", F.coalesce("_n0", none).alias("_to0"), F.coalesce(F.when(moved, F.col("_n1")).otherwise(F.col("_n0")), none).alias("_to1"))
    ends = F.transform("segments", lambda s: s["end_ms"])
    tops = tops.withColumn("_lo", F.least("_start", F.array_min(F.transform("segments", lambda s: s["start_ms"])))).withColumn("_hi", F.array_max(F.concat(ends, "_to0", "_to1")))
    chained = intervals.islands(tops, keys, 0, "_lo", "_hi", [ident])
    kinds = dict(chained.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, ident)) + ", segments array<struct<start_ms: bigint, end_ms: bigint>>"
    dealt = chained.select(*keys, "island", ident, "segments", "_start", "_to0", "_to1").repartition(*keys, "island").sortWithinPartitions(*keys, "island", ident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in (*keys, "island")):
                    yield _turns(held, [*keys, ident], margin)
                    held = []
                held.append(row)
        if held:
            yield _turns(held, [*keys, ident], margin)

    return dealt.mapInArrow(run, schema)


def _turns(chain: list[dict], names: list[str], margin: int) -> pa.RecordBatch:
    """The topics of a chain, each grown in its turn as far as the others leave room."""
    owner = np.repeat(np.arange(len(chain)), [len(t["segments"]) for t in chain])
    start, end = (np.array([s[k] for t in chain for s in t["segments"]]) for k in ("start_ms", "end_ms"))
    firsts = np.append(0, np.cumsum([len(t["segments"]) for t in chain]))
    free = lambda i, a, b: not np.any((a < end - margin) & (b > start + margin) & (owner != i))
    for i, topic in enumerate(chain):
        a, z = firsts[i], firsts[i + 1] - 1
        back = topic["_start"] is not None and free(i, topic["_start"], start[a])
        if back:
            start[a] = topic["_start"]
        was = end[z]
        for to in topic["_to1" if back else "_to0"]:
            if not free(i, was, to):
                break
            end[z] = to
    kind = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    grown = [[{"start_ms": int(start[j]), "end_ms": int(end[j])} for j in range(firsts[i], firsts[i + 1])] for i in range(len(chain))]
    return pa.record_batch({k: pa.array([t[k] for t in chain]) for k in names} | {"segments": pa.array(grown, kind)})
