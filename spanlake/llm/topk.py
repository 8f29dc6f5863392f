"""Exact top-k by integer inner product: branch and bound over dimension blocks in vertical layout.

Candidates are dealt into blocks of bounded size, queries likewise, and each pair of blocks is one group. Within a
group the candidates lie column by column. A query accumulates its products block of dimensions by block of dimensions;
after each block, candidates whose partial score plus the Cauchy-Schwarz bound of the remaining mass can't reach the
query's k-th best score so far are compacted away. The first block of candidates is searched before the others and its
k-th best scores are the floors from which these start. Each group returns the best k of each of its queries and a
window over the query merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import cut

#: Dimensions of a block, candidates and queries of a group.
DIMS, CANDIDATES, QUERIES = 16, 8192, 8192


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of query, row ids, scores) of the ``k`` best rows of each query, ties to smaller ids, not itself.

    Rows that score less than a query's floor may be left out.
    """
    order = np.argsort(row_ids, kind="stable")
    ids = row_ids[order]
    dims = rows.shape[1]
    cuts = list(range(0, dims, DIMS))
    # float64 products are exact while all sums stay below 2**53; beyond, the integers themselves are multiplied
    size = np.abs(rows).max(initial=0).astype(float) * np.abs(queries).max(initial=0).astype(float) * dims
    kind = np.float64 if size < 2.0**52 else np.int64
    columns = np.ascontiguousarray(rows[order].T.astype(kind))  # vertical: a row for each dimension
    tail = np.sqrt([np.sum(columns[c:].astype(float) ** 2, axis=0) for c in cuts[1:]])
    for i, q in enumerate(queries.astype(kind)):
        rest = [float(np.sqrt(np.sum(q[c:].astype(float) ** 2))) for c in cuts[1:]]
        live, score = np.flatnonzero(ids != query_ids[i]), None
        given = -np.inf if floors is None else floors[i] - 1e-9 * (1 + abs(floors[i]))
        for step, c in enumerate(cuts):
            block = q[c : c + DIMS] @ (columns[c : c + DIMS] if len(live) == len(ids) else columns[c : c + DIMS, live])
            score = block if score is None else score + block
            if step < len(cuts) - 1 and (len(live) > k or np.isfinite(given)):
                room = tail[step][live] * rest[step]
                room = room + 1e-6 * (1 + room)
                floor = np.partition(score - room, len(live) - k)[len(live) - k] if len(live) > k else given  # k rows reach at least this much
                keep = score + room >= max(floor, given)
                live, score = live[keep], score[keep]
        if np.isfinite(given):
            keep = score >= given
            live, score = live[keep], score[keep]
        if len(live) > k:
            keep = score >= np.partition(score, len(live) - k)[len(live) - k]
            live, score = live[keep], score[keep]
        top = np.lexsort((ids[live], -score))[:k]
        yield i, ids[live[top]], score[top].astype(np.int64)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id`` and ``q`` = floor(scale * x) as whole numbers; rows with a null or non-finite part are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` highest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own id; ties go to the
    smaller id. Vectors that are null or hold a null or non-finite part, and rows with a null id, take no part. Vectors
    of different lengths are compared as if padded with zeros. Rows that repeat an id are each a candidate, and one
    query (its least vector). An empty table gives no rows. All sums must fit into a long.
    """
    rows = cut(quantised(vectors, id_col, vector_col, scale))
    n, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    width = width or 0
    padded = rows.select("vec_id", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q"))).alias("q"))
    queries = cut(padded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")))
    blocks, sets = -(-n // CANDIDATES) or 1, -(-queries.count() // QUERIES) or 1
    queries = queries.withColumn("set", F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int"))
    # rows are dealt by their vectors too, so that repeated ids don't crowd a block
    candidates = padded.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).cast("int"))
    columns = ["block", "set", "is_query", "vec_id", "q", "floor"]

    def search(_: tuple, table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy()
        ids, q = table["vec_id"].to_numpy(), _matrix(table["q"]) if width else np.zeros((table.num_rows, 1), np.int64)
        floors = table["floor"].to_numpy()[is_query]
        found = [(np.full(len(r), ids[is_query][i]), r, s) for i, r, s in best(q[is_query], ids[is_query], q[~is_query], ids[~is_query], k, floors)]
        parts = [np.concatenate([f[j] for f in found]) if found else np.empty(0, np.int64) for j in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, parts), strict=True)))

    def searched(rows: DataFrame, asked: DataFrame, lo: int, hi: int) -> DataFrame:
        """What the queries find in the blocks ``lo`` to ``hi``."""
        rows = rows.where(F.col("block").between(lo, hi)).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
        rows = rows.withColumn("is_query", F.lit(False)).withColumn("floor", F.lit(float("-inf")))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("is_query", F.lit(True))
        return rows.select(columns).unionAll(asked.select(columns)).groupBy("block", "set").applyInArrow(search, "query_id long, vec_id long, score long")

    found = searched(candidates, queries.withColumn("floor", F.lit(float("-inf"))), 0, 0)
    if blocks > 1:
        found = cut(found)
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k).drop("n")
        rest = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = found.unionAll(searched(candidates, rest, 1, blocks - 1))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
