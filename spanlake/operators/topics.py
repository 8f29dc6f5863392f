"""Rules over neighbouring and competing topics."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions import titles
from spanlake.functions.text import jaccard, keywords, title_similarity
from spanlake.functions.times import parse_ms
from spanlake.operators.folds import fold
from spanlake.operators.intervals import merge
from spanlake.operators.joins import asof, going, overlap_join
from spanlake.storage import checkpoints


def merge_flagged_pairs(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """``df`` with ``pair``: rows whose ``flag`` holds join the row before, greedily in pairs.

    In a run of true flags every second one takes effect, which is what merging from left to right without chains does.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_pos", F.row_number().over(w)).withColumn("_f", F.coalesce(flag, F.lit(False)))
    last_false = F.max(F.when(~F.col("_f"), F.col("_pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    takes = F.col("_f") & ((F.col("_pos") - last_false) % 2 == 1)
    return df.withColumn("pair", F.sum(F.when(takes, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_pos", "_f")


def suppress(df: DataFrame, keys: list[str], ident: str, score: str, width: int, most: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression: a row goes if its overlap with a better kept row exceeds ``most`` of their union.

    Better means a higher score, then shorter, then a smaller id. Instead of one fold per key, rounds decide at once all
    rows whose better rivals are decided; competing pairs come from a binned join. Needs ``spark.checkpoint.dir``.
    """
    rows = df.select(*keys, ident, score, "start_ms", "end_ms")
    left = rows.select(*keys, F.col(ident).alias("l"), F.col(score).alias("ls"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    right = rows.select(*keys, F.col(ident).alias("r"), F.col(score).alias("rs"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    pairs = overlap_join(left, right, keys, width).where("l <> r")
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    union = (F.col("l_end") - F.col("l_start")) + (F.col("r_end") - F.col("r_start")) - shared
    rank = lambda s, a, b, i: F.struct(-F.col(s), F.col(b) - F.col(a), F.col(i))
    better = rank("rs", "r_start", "r_end", "r") < rank("ls", "l_start", "l_end", "l")
    rivals = pairs.where((shared > most * union) & better).select(F.col("l").alias("id"), F.col("r").alias("rival")).checkpoint()
    kept = undefeated(rows.select(F.col(ident).alias("id")), rivals)
    return df.join(kept.select(F.col("id").alias(ident)), ident, "left_semi")


def undefeated(ids: DataFrame, rivals: DataFrame) -> DataFrame:
    """The ``id``s that a greedy pass keeps: each goes if one of its better ``rival``s is kept.

    Each round decides at once all whose better rivals are decided, or of which one is kept. ``rivals`` (``id``,
    ``rival``) must be acyclic and materialised.
    """
    state = ids.join(rivals.select("id").distinct().withColumn("open", F.lit(True)), "id", "left")
    state = state.select("id", F.when(F.col("open"), F.lit(None).cast("boolean")).otherwise(True).alias("kept")).checkpoint()
    while not state.where("kept is null").isEmpty():
        seen = rivals.join(state.select(F.col("id").alias("rival"), F.col("kept").alias("k")), "rival")
        seen = seen.groupBy("id").agg(F.max(F.coalesce("k", F.lit(False))).alias("lost"), F.min(F.col("k").isNotNull()).alias("decided"))
        state = state.join(seen, "id", "left").select("id", F.coalesce("kept", F.when(F.col("lost"), False).when(F.col("decided"), True)).alias("kept")).checkpoint()
    return state.where("kept").select("id")


def belongs_to_previous(before: Column, title: Column, other_chunk: Column, gap: Column, stop: Sequence[str], window: int, near: int, close: int) -> Column:
    """Whether a topic continues the one before it in another chunk: it begins from 2,000 before its end to ``window`` after,
    and the titles are similar (above .45, or .3 if nearer than ``near``), one holds the other, it is ``close``, or the
    titles share more than a quarter of their keywords."""
    similar = title_similarity(before, title, stop)
    shared = jaccard(keywords(before, stop), keywords(title, stop))
    alike = (similar > 0.45) | ((similar > 0.3) & (gap < near)) | F.contains(before, title) | F.contains(title, before) | (gap < close) | (shared > 0.25)
    return F.coalesce(other_chunk & (gap >= -2000) & (gap < window) & alike, F.lit(False))


def absorb_short(df: DataFrame, keys: list[str], ident: str, title: str, candidate: Column, gap: int, close: int, stop: Sequence[str]) -> DataFrame:
    """Topics of a key in order of start; a ``candidate`` goes into the kept one before if it begins from 1,000 before that
    one's end to ``gap`` after, and is ``close`` or has a similar title (above .35, or a quarter of the keywords shared).

    A row that is no candidate always starts anew. A key's rows are streamed in order with the last kept topic as the state.
    """
    rows = df.select(*keys, "start_ms", "end_ms", F.col(ident).cast("long").alias("_id"), F.col(title).alias("_title"), keywords(F.col(title), stop).alias("_words"), F.coalesce(candidate, F.lit(False)).alias("_c"))

    def step(part: Iterator[dict]) -> Iterator[dict]:
        last: dict = {}
        for x in part:
            x["_words"] = x["_words"] and tuple(x["_words"])
            after = x["start_ms"] - last["end_ms"] if last and x["start_ms"] is not None and last["end_ms"] is not None else None
            if x["_c"] and after is not None and -1000 <= after <= gap and (
                after < close or titles.similarity(last["_title"], last["_words"], x["_title"], x["_words"]) > 0.35 or titles.shared(last["_words"], x["_words"]) > 0.25
            ):
                last["end_ms"] = last["end_ms"] if x["end_ms"] is None else max(last["end_ms"], x["end_ms"])
                last["n"] += 1
                continue
            if last:
                yield {k: last[k] for k in names}
            last = x | {ident: x["_id"], "n": 1}
        if last:
            yield {k: last[k] for k in names}

    names, kinds = [*keys, ident, "start_ms", "end_ms", "n"], dict(df.dtypes)
    return fold(rows, keys, ["start_ms", "_id"], step, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{ident}` bigint, start_ms bigint, end_ms bigint, n int")


def packed(text: str | None, limit: int, marks: str = ".!?") -> list[str]:
    """Paragraphs packed into chunks of at most ``limit`` characters, trimmed; a longer paragraph is packed by its sentences.

    Texts up to the limit stay whole. A sentence that is longer than the limit stands alone.
    """
    if text is None or len(text) <= limit:
        return [] if text is None else [text]
    out, part = [], []
    room = limit

    def close() -> None:
        nonlocal room
        chunk = "".join(part).strip()
        if chunk:
            out.append(chunk)
        part.clear()
        room = limit

    for paragraph in text.split("\n"):
        units = [paragraph + "\n"] if len(paragraph) <= limit else [s + marks[0] for s in re.split(f"[{marks}]", paragraph)]
        if len(units) > 1:
            close()
        for unit in units:
            if len(unit) > room:
                close()
            part.append(unit)
            room -= len(unit)
    close()
    return out


def chunks(df: DataFrame, keys: list[str], ident: str, interval: int, pause: int, semantic: int) -> DataFrame:
    """``keys``, ``ident``, ``chunk``: captions (``start_ms``, ``end_ms``) cut about every ``interval``.

    Counted from the end of the chunk before, a cut falls after a caption that starts at 90 to 110 % of the aim and is
    followed by a pause, the first that has a pause of ``semantic`` within two captions if there is one, else the first;
    without any before the first caption that starts at the aim or later; if that leaves nothing, all the rest is one chunk.
    """
    w = Window.partitionBy(*keys).orderBy("start_ms", ident)
    gap = F.lead("start_ms").over(w) - F.col("end_ms")
    rows = df.select(*keys, ident, "start_ms", "end_ms").withColumn("gap", gap)
    rows = rows.withColumn("near", F.max(F.coalesce((F.col("gap") >= semantic).cast("int"), F.lit(0))).over(w.rowsBetween(-2, 2)))

    def step(part: Iterator[dict]) -> Iterator[dict]:
        held: list[dict] = []  # captions from the last cut on
        last = number = 0
        ended = False
        while True:
            aim = last + interval
            while not ended and (not held or held[-1]["start_ms"] <= 1.1 * aim):
                row = next(part, None)
                ended = row is None
                if not ended:
                    held.append(row)
            if not held:
                return
            fit = [k for k, x in enumerate(held) if 0.9 * aim <= x["start_ms"] <= 1.1 * aim and x["gap"] is not None and x["gap"] >= pause]
            near = [k for k in fit if held[k]["near"]]
            cut = (near or fit or [next((k for k, x in enumerate(held) if x["start_ms"] >= aim), len(held)) - 1])[0] + 1
            if cut <= 0:  # nothing before the aim: all the rest
                yield from ({**{k: x[k] for k in (*keys, ident)}, "chunk": number} for x in held)
                yield from ({**{k: x[k] for k in (*keys, ident)}, "chunk": number} for x in part)
                return
            yield from ({**{k: x[k] for k in (*keys, ident)}, "chunk": number} for x in held[:cut])
            last, number, held = held[cut - 1]["end_ms"], number + 1, held[cut:]

    kinds = dict(df.dtypes)
    return fold(rows, keys, ["start_ms", ident], step, ", ".join(f"{k} {kinds[k]}" for k in (*keys, ident)) + ", chunk long")


def merge_outlines(df: DataFrame, keys: list[str], ident: str, title: str, coverage: str, stop: Sequence[str]) -> DataFrame:
    """The outlines of a key that stay, taken in order of start: one that is like a kept one (the first of these) goes, or
    takes its place if its coverage is higher.

    Alike are equal titles, titles of similarity .6, times that share half of the shorter one, and times that follow each
    other within 5,000 with titles of similarity .3. A key's rows are streamed in order; the state is the outlines that stay.
    """
    low = F.lower(title)
    rows = df.select(*keys, "start_ms", "end_ms", F.col(ident).cast("long").alias("_id"), low.alias("_title"), keywords(low, stop).alias("_words"), F.col(coverage).cast("double").alias("_coverage"))

    def alike(x: dict, y: dict) -> bool:
        if (similar := titles.similarity(x["_title"], x["_words"], y["_title"], y["_words"])) >= 0.6:
            return True
        starts, ends = ([r[c] for r in (x, y) if r[c] is not None] for c in ("start_ms", "end_ms"))
        if not starts or not ends:
            return False
        overlap = min(ends) - max(starts)
        lengths = [r["end_ms"] - r["start_ms"] for r in (x, y) if r["start_ms"] is not None and r["end_ms"] is not None]
        return bool(lengths) and min(lengths) > 0 and max(overlap, 0) >= 0.5 * min(lengths) or (0 <= -overlap <= 5000 and similar >= 0.3)

    def step(part: Iterator[dict]) -> Iterator[dict]:
        kept: list[dict] = []
        for x in part:
            x["_words"] = x["_words"] and tuple(x["_words"])
            at = next((i for i, k in enumerate(kept) if alike(k, x)), None)
            if at is None:
                kept.append(x)
            elif x["_coverage"] is not None and kept[at]["_coverage"] is not None and x["_coverage"] > kept[at]["_coverage"]:
                del kept[at]
                kept.append(x)
        yield from ({**{k: x[k] for k in keys}, ident: x["_id"], "start_ms": x["start_ms"], "end_ms": x["end_ms"]} for x in kept)

    kinds = dict(df.dtypes)
    return fold(rows, keys, ["start_ms", "_id"], step, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{ident}` bigint, start_ms bigint, end_ms bigint")


def outline_score(title: Column, subtopics: Column, signature: Column, generic: Sequence[str]) -> Column:
    """.5, .25 for a signature, .08 for each of three subtopics, .15 for 6 to 20 characters (-.2 below 4), -.25 for a generic
    word, .05 for four different characters; within [0, 1]."""
    size = F.length(title)
    fit = F.when(size.between(6, 20), 0.15).when(size < 4, -0.2).otherwise(0.0)
    vague = F.lit(False)
    for word in generic:
        vague = vague | F.contains(title, F.lit(word))
    varied = F.when(F.size(F.array_distinct(F.split(title, ""))) >= 4, 0.05).otherwise(0.0)
    score = 0.5 + F.when(signature, 0.25).otherwise(0.0) + F.least(0.08 * subtopics, F.lit(0.24)) + fit + F.when(vague, -0.25).otherwise(0.0) + varied
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def topic_score(quality: Column, seconds: Column, model: Column, least: float = 120, most: float = 720) -> Column:
    """Outline quality, fit of the duration and a model's score (if above zero) in the parts .25, .45 and .30, else the
    first two in the parts .35 and .65."""
    near = 0.5 + 0.5 * (1 - F.abs(seconds - (least + most) / 2) / max(most - least, 1.0))
    fit = F.when(seconds <= 0, 0.0).when(seconds < least, seconds / least * 0.4).when(seconds > most, 0.6).otherwise(near)
    mixed = F.when(model > 0, quality * 0.25 + fit * 0.45 + model * 0.30).otherwise(quality * 0.35 + fit * 0.65)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))


def duration_flags(df: DataFrame, least: int, most: int, length: Column | None = None) -> DataFrame:
    """``flag``: too_short, too_long or ok, by the time from start to end or by a ``length`` of its own."""
    length = F.col("end_ms") - F.col("start_ms") if length is None else length
    return df.withColumn("flag", F.when(length < least, "too_short").when(length > most, "too_long").otherwise("ok"))


def backfill(segments: DataFrame, captions: DataFrame, keys: list[str], ident: str, width: int, back: int, forward: int, margin: int) -> DataFrame:
    """``ident``, ``start_ms``, ``end_ms``: segments (``l_start``, ``l_end``) extended over the captions around them.

    ``captions`` have ``r_start``, ``r_end``, ``event_id`` and the flags ``depends``, ``switches``, ``ends``, ``continues``.
    A segment whose first caption depends on what came before begins earlier, by at most ``back``, as long as no caption
    on the way back switches the topic, and none that depends on nothing follows the end of a sentence. It ends up to
    ``forward`` captions later, until a sentence ends and the next caption doesn't continue it, or switches the topic.
    Neither reaches more than ``margin`` into another segment. Segments are judged by their bounds as they were.
    """
    checkpoints(segments.sparkSession)
    w = Window.partitionBy(*keys).orderBy("r_start", "event_id")
    before = F.coalesce(F.lag("ends").over(w), F.lit(True))
    stop = F.col("switches") | (before & ~F.col("depends"))  # such a caption is the first of its way
    caps = captions.withColumn("pos", F.row_number().over(w)).withColumn("stop", stop).withColumn("_goes", ~((before & ~F.col("continues")) | F.col("switches")))
    caps = caps.withColumn("way", F.sum(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.collect_list(F.struct("_goes", F.col("r_end").alias("to"))).over(w.rowsBetween(1, forward))
    told = caps.select(*keys, "pos", "way", F.coalesce(F.col("depends") & ~F.col("stop"), F.lit(False)).alias("_back"), going(after).alias("on"), "r_start", "r_end")
    pairs = overlap_join(segments, told, keys, width, longest=width)
    inside = (F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end"))
    met = pairs.groupBy(ident).agg(F.min_by(F.struct("pos", "way", "_back"), F.struct(~inside, "pos")).alias("first"), F.max_by("on", F.struct(inside, "pos")).alias("on"))
    met = segments.join(met, ident).select(*keys, ident, "l_start", "l_end", "first", "on").checkpoint()  # read by both ways
    blocked = segments.select(*keys, F.col(ident).alias("_other"), (F.col("l_start") + margin).alias("r_start"), (F.col("l_end") - margin).alias("r_end"))

    def free(moves: DataFrame) -> DataFrame:
        """Moves (``l_start`` to ``l_end``) that reach into no other segment."""
        hit = overlap_join(moves, blocked, keys, width, longest=width).where(F.col(ident) != F.col("_other")).select("_move").distinct()
        return moves.join(hit, "_move", "left_anti")

    points = caps.withColumn("more", F.lead("way").over(w) == F.col("way")).where("more").select(*keys, "way", "pos", "r_start", F.col("r_start").alias("r_end"))  # those that another one of their way follows
    reach = met.where("first._back").select(*keys, ident, "first.way", F.col("first.pos").alias("_pos"), F.col("l_start").alias("was"), (F.col("l_start") - back).alias("l_start"), F.col("l_start").alias("l_end"))
    to = overlap_join(reach, points, [*keys, "way"], width, how="within", longest=width).where("pos < _pos").groupBy(*keys, ident, "was").agg(F.min("r_start").alias("l_start"))
    starts = free(to.where("l_start < was").withColumn("l_end", F.col("was")).withColumn("_move", F.col(ident))).select(ident, F.col("l_start").alias("_start"))
    steps = met.select(*keys, ident, F.col("l_end").alias("from"), F.posexplode("on").alias("k", "to")).withColumn("_move", F.concat_ws(":", F.col(ident).cast("string"), F.col("k").cast("string")))
    open_ = free(steps.withColumn("l_start", F.col("from")).withColumn("l_end", F.col("to"))).select("_move", F.lit(True).alias("open"))
    steps = steps.join(open_, "_move", "left")
    on = F.bool_and(F.coalesce("open", F.lit(False))).over(Window.partitionBy(ident).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    ends = steps.withColumn("on", on).where("on").groupBy(ident).agg(F.max_by("to", "k").alias("_end"))
    out = segments.join(starts, ident, "left").join(ends, ident, "left")
    return out.select(ident, F.coalesce("_start", "l_start").alias("start_ms"), F.coalesce("_end", "l_end").alias("end_ms"))


def advised(segments: DataFrame, captions: DataFrame, keys: list[str], ident: str, advice: Column, most: int = 180_000, other: int = 60_000) -> DataFrame:
    """``ident``, ``start_ms``, ``end_ms`` after an advice such as ``extend start by 12 s`` or ``shrink end by 3 s`` (10 s if it
    names none).

    A new start is the last caption start at or before it, a new end the first caption end at or after it; it is taken
    only if it moves the bound the way that was asked. ``extend start`` may move by ``most``, the others by ``other``; larger
    moves, ``remove`` (a topic keeps one segment at least) and anything else leave the segment as it is.
    """
    verb, side = (F.regexp_extract(advice, r"^(extend|shrink) (start|end)", k) for k in (1, 2))
    by = F.coalesce(F.regexp_extract(advice, r"by (\d+) s", 1).try_cast("long"), F.lit(10)) * 1000
    rows = segments.withColumn("_side", side).withColumn("_verb", verb).withColumn("_by", by)
    outwards = F.col("_verb") == "extend"
    allowed = (F.col("_verb") != "") & (F.col("_by") <= F.when(outwards & (F.col("_side") == "start"), most).otherwise(other))
    rows = rows.withColumn("_at", F.when(allowed & (F.col("_side") == "start"), F.greatest(F.lit(0), F.col("l_start") + F.when(outwards, -F.col("_by")).otherwise(F.col("_by")))))
    rows = rows.withColumn("_to", F.when(allowed & (F.col("_side") == "end"), F.col("l_end") + F.when(outwards, F.col("_by")).otherwise(-F.col("_by"))))
    begin, finish = captions.withColumn("_a", F.col("r_start")), captions.withColumn("_b", F.col("r_end"))
    starts = asof(rows.where("_at is not null"), begin, keys, "_at", "r_start", "_a").select(ident, "_a")
    ends = asof(rows.where("_to is not null"), finish, keys, "_to", "r_end", "_b", "forward").select(ident, "_b")
    rows = rows.join(starts, ident, "left").join(ends, ident, "left")
    a = F.when(F.when(outwards, F.col("_a") < F.col("l_start")).otherwise(F.col("_a") > F.col("l_start")), F.col("_a")).otherwise(F.col("l_start"))
    b = F.when(F.when(outwards, F.col("_b") > F.col("l_end")).otherwise(F.col("_b") < F.col("l_end")), F.col("_b")).otherwise(F.col("l_end"))
    return rows.select(ident, a.alias("start_ms"), b.alias("end_ms"))


def apply_actions(segments: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """Topics (``topic``, one row a segment) after actions on gaps: ``create`` (a topic named ``new``), ``merge_to`` (a segment
    more for ``target``, if there is that topic) or anything else (nothing). ``id`` numbers them by their first start."""
    bounds = ["start_ms", "end_ms"]
    made = actions.where("action = 'create' and end_ms > start_ms").select(*keys, F.col("new").alias("topic"), *bounds)
    known = segments.select(*keys, "topic").distinct()
    grown = actions.where("action = 'merge_to'").select(*keys, F.col("target").alias("topic"), *bounds).join(known, [*keys, "topic"], "left_semi")
    every = segments.select(*keys, "topic", *bounds).unionByName(made).unionByName(grown)
    parts = F.array_sort(F.collect_list(F.struct(*bounds)))  # the segments of one topic
    out = every.groupBy(*keys, "topic").agg(F.min("start_ms").alias("first_start"), F.transform(parts, lambda x: x["end_ms"] - x["start_ms"]).alias("lengths"))
    return out.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy("first_start", "topic")))


def edited(segments: DataFrame, captions: DataFrame, advice: DataFrame, keys: list[str], topic: str, rounds: int, most: int = 180_000, other: int = 60_000) -> DataFrame:
    """``keys``, ``topic``, ``start_ms``, ``end_ms`` of topics' segments after a script of advices, one after another.

    ``segments`` have a row each (``l_start``, ``l_end``); ``advice`` has ``keys``, ``topic``, ``step`` (from 1; up to ``rounds``) and ``text``.
    ``extend``/``shrink`` ``start``/``end`` move the first segment's start or the last one's end as in ``advised``. ``remove segment N`` takes
    out the N-th, if another stays. ``add segment HH:MM:SS,mmm - HH:MM:SS,mmm`` adds one from the last caption start
    at or before the first stamp to the first caption end at or after the second; overlapping segments then become one. Each step
    takes the topics with an advice of its number through the same joins; all others pass by.
    """
    checkpoints(segments.sparkSession)
    own = [*keys, topic]
    now = segments.select(*own, "l_start", "l_end").checkpoint()
    order = Window.partitionBy(*own).orderBy("l_start", "l_end")
    stamp = r"(\d{2}:\d{2}:\d{2}[.,]\d{3})"
    for step in range(1, rounds + 1):
        said = advice.where(F.col("step") == step).select(*own, F.col("text").alias("_said"))
        rows = now.join(said, own, "left").withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(*own)))
        gone = F.regexp_extract("_said", r"^remove segment #?(\d+)", 1).try_cast("int")
        rows = rows.where(~F.coalesce((F.col("_n") > 1) & (F.col("_k") == gone), F.lit(False)))
        moves = F.regexp_extract("_said", r"^(?:extend|shrink) (start|end)", 1)
        target = F.coalesce(((moves == "start") & (F.col("_k") == 1)) | ((moves == "end") & (F.col("_k") == F.col("_n"))), F.lit(False))
        rows = rows.withColumn("_id", F.concat_ws(":", *[F.col(c).cast("string") for c in own], F.col("_k").cast("string"))).withColumn("_target", target).checkpoint()
        moved = advised(rows.where("_target").select(*keys, "_id", "l_start", "l_end", "_said"), captions, keys, "_id", F.col("_said"), most, other)
        kept = rows.join(moved, "_id", "left").select(*own, F.coalesce("start_ms", "l_start").alias("l_start"), F.coalesce("end_ms", "l_end").alias("l_end"))
        new = said.join(now.select(*own).distinct(), own, "left_semi").withColumn("_id", F.concat_ws(":", *[F.col(c).cast("string") for c in own]))
        new = new.where(F.col("_said").startswith("add segment")).select(*own, "_id", *[parse_ms(F.replace(F.regexp_extract("_said", rf"{stamp}\s*[-~]\s*{stamp}", i), F.lit("."), F.lit(","))).alias(n) for i, n in ((1, "_at"), (2, "_to"))])
        new = asof(new.where("_at is not null"), captions.withColumn("_a", F.col("r_start")), keys, "_at", "r_start", "_a")
        new = asof(new, captions.withColumn("_b", F.col("r_end")), keys, "_to", "r_end", "_b", "forward").where("_b > _a")
        both = kept.unionByName(new.select(*own, F.col("_a").alias("l_start"), F.col("_b").alias("l_end"))).join(new.select(*own).distinct().withColumn("_grown", F.lit(True)), own, "left").checkpoint()
        united = merge(both.where("_grown").select(*own, "l_start", "l_end"), own, 0, "l_start", "l_end").select(*own, "l_start", "l_end")
        now = both.where("_grown is null").select(*own, "l_start", "l_end").unionByName(united)
    return now.select(*own, F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms"))
