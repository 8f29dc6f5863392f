"""Interval and as-of joins as equi-joins: bins for overlaps, unions with windows for as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bins of a level are so many times wider than those of the level below; levels where nothing is known of lengths.
_FACTOR, _LEVELS = 16, 4


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, how: str = "overlap", closed: bool = False, margin: int = 0, longest: int | None = None) -> DataFrame:
    """Pairs of ``left`` (``l_start``, ``l_end``) and ``right`` (``r_start``, ``r_end``) rows of equal ``keys``.

    ``how``: ``overlap`` (half-open unless ``closed``; ``margin`` widens the left side) or ``within`` (right lies inside
    left). Both sides are dealt into time bins of ``width``, longer intervals into the bins of a level whose width fits
    their length, so that a row meets at most two bins of a level. A pair meets at the level of its longer
    interval and is kept only in the first bin that both share, so it appears once; the join is an equi-join on keys,
    level and bin whose hot bins AQE can split. ``longest`` is about the length of the longest intervals, the margin
    included: no more levels are made than that needs (one, up to ``width``). Longer ones take more bins of the highest
    level; results don't depend on it, and the plan needs no look at the data. Where most rows are short ones of one side,
    ``width`` is a good ``longest``: they are then dealt once instead of once a level, and only the few long ones take several bins.
    """
    lo, hi = F.col("l_start") - margin, F.col("l_end") + margin
    levels = next((k + 1 for k in range(_LEVELS) if longest is not None and width * _FACTOR**k >= longest), _LEVELS)
    widths = [width * _FACTOR**k for k in range(levels)]
    level = lambda a, b: sum(((b - a > w).cast("int") for w in widths[:-1]), F.lit(0))
    bounds = {"l": (F.least(lo, hi), F.greatest(lo, hi)), "r": (F.least("r_start", "r_end"), F.greatest("r_start", "r_end"))}
    single = levels == 1
    size = F.lit(width) if single else F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), F.col("_level") + 1)
    extra = [] if single else ["_level", "_roles"]

    def dealt(df: DataFrame, side: str, own: str, other: str) -> DataFrame:
        """Rows by level and bin; of two rows at a level one at least is there in its own right (``roles``)."""
        a, b = bounds[side]
        if not single:
            df = df.withColumn("_own", level(a, b)).withColumn("_level", F.explode(F.sequence("_own", F.lit(levels - 1))))
            here = F.col("_own") == F.col("_level")  # at the lowest level no row is but a guest
            roles = F.when(here & (F.col("_level") == 0), F.array(F.lit("both"))).when(here, F.array(F.lit("both"), F.lit(own))).otherwise(F.array(F.lit(other)))
            df = df.withColumn("_roles", F.explode(roles)).drop("_own")
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(a / size), F.floor(b / size))))

    if how == "within":
        test: Column = (F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end"))
    elif closed:
        test = (F.col("r_start") <= hi) & (F.col("r_end") >= lo)
    else:
        test = (F.col("r_start") < hi) & (F.col("r_end") > lo)
    first = F.greatest(F.floor(bounds["l"][0] / size), F.floor(bounds["r"][0] / size))
    met = dealt(left, "l", "left", "right").join(dealt(right, "r", "right", "left"), [*keys, "_bin", *extra])
    return met.where(test & (F.col("_bin") == first)).drop("_bin", *extra)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, ts: str, value: str, direction: str = "backward", slice_ms: int | None = None) -> DataFrame:
    """``left`` with ``value`` of the last ``right`` row at or before ``at`` (``forward``: the first at or after).

    One shuffle: both sides are unioned and a window carries the last (next) right value over; ties go to the largest
    (smallest) value. ``slice_ms`` cuts keys into slices of time, for tables in which one key may hold a large share of
    the rows: each slice is handed the last (next) value of the slices before (after) it.
    """
    columns = left.columns
    kept = F.struct(*columns).alias("_row")
    right_first = direction == "backward"
    a = left.select(*keys, F.col(at).alias("_ts"), F.lit(1 if right_first else 0).alias("_side"), kept, F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    b = right.groupBy(*keys, F.col(ts).alias("_ts")).agg((F.max if right_first else F.min)(value).alias("_value"))
    b = b.select(*keys, "_ts", F.lit(0 if right_first else 1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "_value")
    both, by = a.unionByName(b), list(keys)
    if slice_ms is not None:
        both, by = both.withColumn("_slice", F.floor(F.col("_ts") / slice_ms)), [*keys, "_slice"]
        ends = both.groupBy(*by).agg((F.max_by if right_first else F.min_by)("_value", F.when(F.col("_value").isNotNull(), F.col("_ts"))).alias("_end"))
        over = Window.partitionBy(*keys).orderBy("_slice")
        carry = F.last("_end", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)) if right_first else F.first("_end", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
        both = both.join(ends.withColumn("_carry", carry).drop("_end"), by)
    w = Window.partitionBy(*by).orderBy("_ts", "_side")
    if right_first:
        found = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("_value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if slice_ms is not None:
        found = F.coalesce(found, "_carry")
    return both.withColumn("_found", found).where("_row is not null").select("_row.*", F.col("_found").alias(value))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, ts: str) -> DataFrame:
    """``left`` with ``previous``, ``next`` and ``nearest`` (ties: previous) instant of ``right``; ends are clamped."""
    r = right.select(*keys, F.col(ts).alias("_t")).withColumn("previous", F.col("_t")).withColumn("next", F.col("_t"))
    out = asof(asof(left, r, keys, at, "_t", "previous"), r, keys, at, "_t", "next", "forward")
    out = out.withColumn("previous", F.coalesce("previous", "next")).withColumn("next", F.coalesce("next", "previous"))
    closer = F.abs(F.col(at) - F.col("previous")) <= F.abs(F.col("next") - F.col(at))
    return out.withColumn("nearest", F.when(closer, F.col("previous")).otherwise(F.col("next")))


def align(clips: DataFrame, strategy: str = "balanced", most: int = 5_000) -> DataFrame:
    """Boundaries moved to instants: ``start_previous``/``start_next``/``start_nearest`` and the like for ``end``.

    ``content_preserving``: start to the previous, end to the next; ``strict``: start to the next, end to the previous
    (if that leaves a clip); ``previous``/``next``: both so; ``balanced``: both to the nearest. No boundary moves by
    more than ``most``; without instants both move outwards by 2,000.
    """
    pick = {"content_preserving": ("previous", "next"), "strict": ("next", "previous"), "previous": ("previous", "previous"), "next": ("next", "next"), "balanced": ("nearest", "nearest")}[strategy]

    def moved(side: str, how: str, outwards: int) -> Column:
        to = F.col(f"{side}_{how}")
        bounded = F.greatest(F.least(to, F.col(side) + most), F.col(side) - most)
        return F.when(to.isNull(), F.greatest(F.lit(0), F.col(side) + outwards)).otherwise(bounded)

    start, end = moved("start_ms", pick[0], -2_000), moved("end_ms", pick[1], 2_000)
    valid = start < end
    return clips.withColumn("aligned_start", F.when(valid, start).otherwise(F.col("start_ms"))).withColumn("aligned_end", F.when(valid, end).otherwise(F.col("end_ms")))


def first_or_last(pairs: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column], inside: Column, last: bool = False) -> DataFrame:
    """Per ``keys`` the first (last) contained row's value, else the first (last) overlapping one's."""
    rank = F.struct(F.when(inside, 0).otherwise(1), *order) if not last else F.struct(F.when(inside, 1).otherwise(0), *order)
    best = F.max_by if last else F.min_by
    return pairs.groupBy(*keys).agg(best(value, rank).alias("value"))


def going(after: Column) -> Column:
    """The ``to`` of the rows of a list up to the first whose ``_goes`` doesn't hold."""
    upto = F.transform(after, lambda x, i: F.struct(x["to"].alias("to"), F.forall(F.slice(after, 1, i + 1), lambda y: y["_goes"]).alias("ok")))
    return F.transform(F.filter(upto, lambda x: x["ok"]), lambda x: x["to"])
