"""The small relational store: ranking, pages, upserts, consistency and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import two_places


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with its row number by ``order`` within ``keys``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes them before the shuffle."""
    return ranked(df, keys, order, "_rank").where(F.col("_rank") <= k).drop("_rank")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page (from 1) in a total order, by distributed sort and limit."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``by``; a map-side combined maximum instead of a sort."""
    rest = [c for c in df.columns if c not in (*keys, *by)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*by, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (*by, *rest)])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``target`` with ``columns`` taken from ``source`` where its keys match, and the source's new keys added."""
    new = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    merged = target.join(new, list(keys), "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])
    fresh = source.join(target, list(keys), "left_anti")
    return merged.unionByName(fresh.select(*[c for c in target.columns if c in (*keys, *columns)]), allowMissingColumns=True)


def positional_zip(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Rows joined by their position within ``keys``; a key whose counts differ is dropped as a whole."""
    a, b = ranked(left, keys, left_order, "_pos"), ranked(right, keys, right_order, "_pos")
    a = a.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    b = b.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return a.join(b, [*keys, "_pos", "_n"]).drop("_pos", "_n")


def diversify(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[Column], length: Column | None = None) -> DataFrame:
    """Scores of a key that are all equal (of several rows) get a bonus for ``length`` (.15 over 200, .08 over 100, .03 over
    50) and move linearly by rank from -.1 to +.1; they stay within [.1, 1] and have two places."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    flat = (F.min(score).over(w) == F.max(score).over(w)) & (n > 1)
    step = 0.2 * (F.row_number().over(w.orderBy(*order)) - 1) / F.greatest(n - 1, F.lit(1)) - 0.1
    bonus = F.lit(0.0) if length is None else F.when(length > 200, 0.15).when(length > 100, 0.08).when(length > 50, 0.03).otherwise(0.0)
    moved = two_places(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col(score) + bonus + step)))
    return df.withColumn(score, F.when(flat, moved).otherwise(F.col(score)))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def child_counts(parent: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """``parent`` with a count of each child table; each is aggregated before the join."""
    for name, child in children.items():
        parent = parent.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parent


def sync_collections(source: DataFrame, deleted: DataFrame, stored: DataFrame, clips: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections (``project``, ``title``, ``what``) and links (``project``, ``title``, ``clip``, ``order_index``) after a sync.

    ``source`` has ``project``, ``id``, ``title`` and ``clip_ids``; those whose ``id`` is in ``deleted`` are passed over. A
    collection is one of a project and title: it is updated if ``stored`` has it, else created. Clip ids are translated by
    ``clips`` (``original``, ``clip``), unknown ones left out; links that ``bridge`` has stay as they are.
    """
    by = ["project", "title"]
    live = source.join(deleted.select("id"), "id", "left_anti")
    first = live.groupBy(*by).agg(F.min_by("clip_ids", "id").alias("clip_ids"))
    both = stored.select(*by, F.lit(True).alias("_old")).join(first.withColumn("_new", F.lit(True)), by, "full")
    what = F.when(F.col("_new").isNull(), "kept").when(F.col("_old"), "updated").otherwise("created")
    wanted = first.select(*by, F.posexplode("clip_ids").alias("_at", "original")).join(clips.select("original", "clip"), "original")
    wanted = wanted.withColumn("order_index", F.row_number().over(Window.partitionBy(*by).orderBy("_at")) - 1)
    fresh = wanted.groupBy(*by, "clip").agg(F.min("order_index").alias("order_index")).join(bridge, [*by, "clip"], "left_anti")
    return both.select(*by, what.alias("what")), bridge.select(*by, "clip", "order_index").unionByName(fresh)


def delete_projects(projects: DataFrame, asked: DataFrame, tasks: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of ``project`` (``projects``: ``project``, ``status``), ``task`` (``tasks``: ``project``, ``state``) and each of
    ``children`` when the ``asked`` projects go. One with a processing task is refused unless it is completed or failed."""
    busy = tasks.where("state = 'processing'").select("project").distinct()
    open_ = projects.where("status not in ('completed', 'failed')").select("project")
    gone = asked.select("project").distinct().join(busy.join(open_, "project", "left_semi"), "project", "left_anti")
    return {name: df.join(gone, "project", "left_anti") for name, df in {"project": projects, "task": tasks, **children}.items()}
