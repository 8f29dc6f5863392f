"""Temperature mixing of sources, realised as budgeted permutations of blocks.

Source shares of tokens are raised to an exponent and normalised. The exponent is bisected (many points at once, each
pass one small aggregation) until the weights have a target entropy, or until the budget that uses every source at
least once repeats none more than a limit. A source's documents are dealt into blocks in a pseudo-random order that
differs by epoch; whole blocks are taken while the quota lasts and the last block is taken by running sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import cut, quoted

#: Points of a bisection pass and passes: the exponent is exact to 33**-8.
POINTS, PASSES = 32, 8
#: Tokens that a block should hold.
BLOCK_TOKENS = 200_000


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _log(x: float) -> float:
    return math.log(x) if x > 0 else -math.inf


def solve_exponent(sources: DataFrame, max_epochs: float | None = None, entropy: float | None = None) -> float:
    """The exponent in [0, 1] for ``sources`` (``source``, ``tokens`` > 0).

    With ``max_epochs`` the smallest exponent (flattest weights) for which ``(largest share / smallest share) ** (1 -
    exponent)`` stays within the limit; with ``entropy`` the largest exponent whose weights have at least so many nats.
    Both grow or fall monotonically, so bisection is exact to the last pass. Out of reach means the nearer end.
    """
    t = sources.agg(F.sum("tokens").alias("t")).first().t
    if not t:
        return 1.0
    log_share = F.log(F.col("tokens") / F.lit(float(t)))
    spread = sources.agg((F.max(log_share) - F.min(log_share)).alias("d")).first().d
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        if max_epochs is not None:
            good = [(1 - a) * spread <= _log(max_epochs) for a in grid]
            at = next((i for i, g in enumerate(good) if g), POINTS)
            low, high = grid[max(at - 1, 0)], grid[at]
        else:
            sums = sources.agg(*[F.struct(F.sum(F.exp(log_share * a)).alias("z"), F.sum(F.exp(log_share * a) * log_share * a).alias("e")).alias(f"a{i}") for i, a in enumerate(grid)]).first()
            good = [_log(s.z) - s.e / s.z >= entropy for s in sums]
            at = max((i for i, g in enumerate(good) if g), default=0)
            low, high = grid[at], grid[min(at + 1, POINTS)]
        if low == high:
            break
    return high if max_epochs is not None else low


_KEYS = ("_k1", "_k2")


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    """A 128-bit key of what a row of ``docs`` is used for: rows that agree in id, source and text share one."""
    parts = [F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col)]
    return [F.xxhash64(F.lit(i), *parts).alias(k) for i, k in enumerate(_KEYS)]


def _place(seed: int) -> Column:
    return F.xxhash64("_k1", "_k2", "epoch", F.lit(seed))


def _uses(docs: DataFrame, max_epochs: float | None, entropy: float | None, budget: float | None, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """One row per use: ``doc_id``, ``source``, ``tokens``, ``_k1``, ``_k2``, ``epoch``, ``block``, ``place``; see ``plan``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), word_count(F.col(text_col)).alias("tokens"), *_keyed(docs, id_col, source_col, text_col))
    rows = cut(rows)
    sources = cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    live = sources.where("tokens > 0")
    exponent = solve_exponent(live, max_epochs, entropy)
    t = live.agg(F.sum("tokens").alias("t"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(exponent))).alias("z"), F.max(F.pow(F.col("tokens").cast("double"), F.lit(1 - exponent))).alias("top")).first()
    z, top = t.z or 1.0, t.top or 1.0
    total = z * top if budget is None else float(budget)  # tokens / weight is largest for the largest source
    quota = F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.lit(z) * F.lit(total)
    blocks = F.ceil(F.col("tokens") / BLOCK_TOKENS) + 1
    need = sources.select(
        "source", F.when(F.col("tokens") > 0, F.floor(quota / F.col("tokens") + 1e-9)).otherwise(1).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, quota).otherwise(0.0).alias("quota"), F.col("tokens").alias("all_tokens"),
        blocks.alias("blocks"), F.ceil(F.sqrt(blocks)).cast("long").alias("runs"),
    ).withColumn("left", F.greatest(F.lit(0.0), F.round(F.col("quota") - F.col("whole") * F.col("all_tokens"), 6)))
    few = sources.limit(10_001).count() <= 10_000
    used = rows.join(F.broadcast(need) if few else need, "source")
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    used = used.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "source", "epoch", *_KEYS), "blocks")).withColumn("place", _place(seed))
    columns = ["doc_id", "source", "tokens", *_KEYS, "epoch", "block", "place"]
    whole = used.where("epoch < whole").select(columns)
    # the order of blocks is one of runs, and within a run one of its blocks: no window sees more than a root of a source's blocks
    part = used.where("epoch = whole and `left` > 0").select(*columns, F.pmod(F.xxhash64("block", F.lit(seed)), "runs").alias("run"), "left")
    sums = cut(part.groupBy("source", "run", "block", "left").agg(F.sum("tokens").alias("in_block")))
    earlier = lambda w: F.coalesce(F.sum("inside").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_run = sums.groupBy("source", "run", "left").agg(F.sum("in_block").alias("inside"))
    of_run = of_run.withColumn("ahead", earlier(Window.partitionBy("source").orderBy("run"))).where("ahead < `left`").select("source", "run", "ahead")
    of_block = sums.join(of_run, ["source", "run"]).withColumnRenamed("in_block", "inside")
    before = of_block.withColumn("before", F.col("ahead") + earlier(Window.partitionBy("source", "run").orderBy(F.xxhash64(F.lit(seed), "block"), "block"))).where("before < `left`")
    full = before.where("before + inside <= `left`").select("source", "block")
    last = before.where("before + inside > `left`").select("source", "block", "before")
    inner = Window.partitionBy("source", "block").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    some = part.join(last, ["source", "block"]).withColumn("upto", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).where("upto < `left`").select(columns)
    return whole.unionAll(part.join(full, ["source", "block"]).select(columns)).unionAll(some)


def plan(docs: DataFrame, max_epochs: float | None = 2.0, entropy: float | None = None, budget: float | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per use of a document: ``doc_id``, ``source``, ``tokens``, ``epoch`` (from 0), ``block``, ``place``.

    ``budget`` is the total of tokens; by default the least that uses every source once. A source's quota is its weight
    times the budget: whole epochs, then blocks of one more in that epoch's order, then documents of the last block
    while the running sum before them is below what is left. ``place`` is a pseudo-random key by which the mixture can
    be sorted. Tokens are runs of characters other than blanks. A null source counts as one source of its own (empty
    name). Null and empty texts have no tokens; they are used wherever their place in the order is reached. Rows with a
    null id are treated like others; repeated rows count each. An empty table, or one without tokens, uses every row
    once.
    """
    return _uses(docs, max_epochs, entropy, budget, seed, id_col, source_col, text_col).select("doc_id", "source", "tokens", "epoch", "block", "place")


def mix(docs: DataFrame, max_epochs: float, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixture itself: rows of ``docs`` (all its columns), each as often as ``plan`` uses it, in the order of ``place``.

    Every row is there at least once. Of several rows that agree in id, source and text each is used equally often; if
    the plan uses only some of them once more, one of them stands for those uses.
    """
    again = _uses(docs, max_epochs, None, None, seed, id_col, source_col, text_col).where("epoch > 0")
    again = cut(again.groupBy(*_KEYS, "epoch").agg(F.count("*").alias("n")))
    keyed = docs.select(F.struct(*quoted(docs.columns)).alias("row"), *_keyed(docs, id_col, source_col, text_col))
    few = again.limit(1_000_001).count() <= 1_000_000
    more = keyed.join(F.broadcast(again) if few else again, list(_KEYS))
    same = cut(keyed.groupBy(*_KEYS).agg(F.count("*").alias("rows")).where("rows > 1"))
    columns = ["row", *_KEYS, "epoch"]
    if not same.isEmpty():
        more = more.join(same, list(_KEYS), "left")
        odd = more.where("n < rows").dropDuplicates([*_KEYS, "epoch"]).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))
        more = more.where("rows is null or n = rows").select(columns).unionAll(odd.select(columns))
    every = keyed.withColumn("epoch", F.lit(0)).select(columns).unionAll(more.select(columns))
    return every.select("row", _place(seed).alias("place")).orderBy("place").select("row.*")
