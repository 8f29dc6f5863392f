"""Connected components by repeated contraction: each node joins its neighbour of least priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import cut, small

#: Rows (two numbers each) of a table that may be broadcast.
FEW = 100_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node of an edge; ``root`` is the smallest node that is reachable.

    Priorities are hashes that change with the round, so a path halves each time whatever its numbering. A round is
    one map-side combined minimum and joins whose hot keys AQE can split; no node's neighbours are ever gathered.
    Loops and edges with a null end are ignored; no edges give no rows. ``edges`` is read more than once: cut its lineage
    before. While edges are left, joins are merge joins; when nodes are given their roots, tables of at most ``FEW`` rows are
    broadcast, so that a component with most of the nodes is no hot key, and larger ones are left to AQE's skew handling.
    """
    pairs = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a <> b")
    moved = []
    while not pairs.isEmpty():
        def order(column: str, step: int = len(moved)):
            return F.struct(F.xxhash64(F.lit(step), F.col(column)).alias("h"), F.col(column).alias("to"))

        both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), order("b").alias("o")), F.struct(F.col("b").alias("node"), order("a").alias("o")))).alias("e")).select("e.*")
        moves = cut(both.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least("o", order("node"))["to"].alias("to")))
        moved.append(moves)
        left, right = moves.toDF("a", "ta"), moves.toDF("b", "tb")
        pairs = cut(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not moved:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    nodes = moved[0]
    for moves in moved[1:]:
        nodes = nodes.toDF("node", "at").join(small(moves.toDF("at", "next"), FEW), "at", "left").select("node", F.coalesce("next", "at").alias("to"))
    nodes = cut(nodes)
    least = cut(nodes.groupBy("to").agg(F.min("node").alias("root")))
    return nodes.join(small(least, FEW), "to").select("node", "root")
