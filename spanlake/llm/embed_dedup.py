"""Near-duplicate vectors: an exact range join in angular distance.

Pivots split the vectors of each label into cells, each vector's home being its nearest pivot. Angles obey the triangle
inequality, so a vector can only be linked into a foreign cell if its angle to that pivot exceeds the cell's radius by
at most the range, and its own home angle by at most twice the range; only there it is replicated. Every link of a home
vector then lies in its own cell, so cells join independently: each counts its home vectors' links and returns a forest
of them. Home vectors of a cell and all its vectors are cut into blocks apart and each pair of blocks is one group, so
no task grows with a group of copies. Within a group both sides are sorted by their angle to the pivot; a vector is
multiplied only with those whose angle differs from its own by at most the range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import cut, small
from spanlake.llm.components import connected_components

#: Different vectors that a cell should have, the most cells of a label, rows of one side of a block, and of a slice whose homes are sought at once.
CELL, CELLS, BLOCK, SLICE = 8192, 256, 8192, 8192
#: What is added to the range for rounding: angles travel as 32-bit numbers.
SLACK = 4e-6


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with their class key, and classes of equal vectors (``rep``: smallest id, ``m``: rows)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64(F.lit(1), "label", "v")).withColumn("h2", F.xxhash64(F.lit(2), "label", "v"))
    classes = rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    return rows.select("vec_id", "ok", "h1", "h2"), classes.withColumn("part", F.xxhash64("label", F.size("v")))


def _placed(classes: DataFrame, reach: float) -> DataFrame:
    """Every class of a label with others: its home cell, its angle there (``own``) and the cells (``c``, ``a``: angle)
    that Voronoi bounds let it reach.

    A label has two pivots at least (its least and its greatest hash), and one for ``CELL`` vectors up to ``CELLS``.
    """
    hashed = classes.withColumn("h", F.xxhash64("rep", "h1", F.lit("pivot")))
    parts = cut(hashed.groupBy("part").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("n > 1"))
    rows = hashed.join(small(parts), "part")
    cells = F.least(F.lit(CELLS), F.greatest(F.lit(2), F.ceil(F.col("n") / CELL)))
    picked = (F.pmod(F.col("h"), F.lit(1 << 30)) < (cells - 2) / F.col("n") * (1 << 30)) | F.col("h").isin(F.col("lo"), F.col("hi"))
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    columns = ["part", "slice", "pivot", "h", "rep", "h1", "m", "v"]
    pivots = rows.where(picked).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("pivot", F.lit(True))
    own = rows.withColumn("slice", F.pmod(F.xxhash64("rep", "h1"), slices).cast("int")).withColumn("pivot", F.lit(False))

    def place(_: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pivot = table["pivot"].to_numpy()
        at = np.flatnonzero(pivot)
        at = at[np.lexsort([table[k].to_numpy()[at] for k in ("h1", "rep", "h")])]
        u = _unit(table["v"].chunk(0))
        mine = np.flatnonzero(~pivot)
        angle = _angle(u[mine] @ u[at].T)
        home = angle.argmin(1)
        least = angle[np.arange(len(mine)), home]
        row, cell = np.nonzero(angle - least[:, None] <= 2 * reach)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(mine)))]).astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angle[row, cell].astype(np.float32))], ["c", "a"])
        out = table.select(["part", "rep", "h1", "m", "v"]).take(pa.array(mine))
        return out.append_column("home", pa.array(home.astype(np.int32))).append_column("own", pa.array(least.astype(np.float32))).append_column("near", pa.ListArray.from_arrays(pa.array(ends), near))

    rows = own.select(columns).unionAll(pivots.select(columns)).groupBy("part", "slice")
    return rows.applyInArrow(place, "part long, rep long, h1 long, m long, v array<double>, home int, own float, near array<struct<c: int, a: float>>")


def _blocks(placed: DataFrame, reach: float) -> DataFrame:
    """Both sides of every pair of blocks: home vectors (``left``) and all vectors that reach the cell."""
    radii = cut(placed.groupBy("part", F.col("home").alias("cell")).agg(F.min("own").alias("lo"), F.max("own").alias("hi")))
    near = placed.select("part", "home", "rep", "h1", "m", "v", F.explode("near").alias("e")).select("*", F.col("e.c").alias("cell"), F.col("e.a").alias("angle")).drop("e")
    near = near.join(small(radii), ["part", "cell"]).where((F.col("home") == F.col("cell")) | F.col("angle").between(F.col("lo") - reach, F.col("hi") + reach)).drop("lo", "hi")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = cut(near.groupBy("part", "cell").agg(blocks(F.count("*")).alias("all_"), blocks(F.count_if(F.col("home") == F.col("cell"))).alias("homes")))
    near = near.join(small(sizes), ["part", "cell"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("rep", "h1"), F.col(n)).cast("int")
    columns = ["part", "cell", "i", "j", "left", "angle", "rep", "h1", "m", "v"]
    left = near.where("home = cell").withColumn("i", dealt("homes")).withColumn("j", spread("all_")).withColumn("left", F.lit(True))
    right = near.withColumn("i", spread("homes")).withColumn("j", dealt("all_")).withColumn("left", F.lit(False))
    return left.select(columns).unionAll(right.select(columns))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal label are linked if their cosine in double precision is at least ``threshold``. Vectors that are
    null, zero, empty or hold null or non-finite parts, and rows with a null label or id, are linked with nothing, as
    are vectors of different lengths. ``n_links`` counts the other rows linked directly (a repeated row is another
    row), ``component_id`` is the smallest id that links reach, ``kept`` whether it is the row's own; both are null and
    true for a null id. Rows that share an id are linked through it.
    """
    rows, classes = _classes(vectors, id_col, vector_col, label_col)
    classes = cut(classes)
    reach = math.acos(threshold) + SLACK
    blocks = _blocks(cut(_placed(classes, reach)), reach)

    def join(_: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, angle, rep, h1, m = (table[k].to_numpy() for k in ("left", "angle", "rep", "h1", "m"))
        u = _unit(table["v"].chunk(0))
        left, right = (x[np.argsort(angle[x], kind="stable")] for x in (np.flatnonzero(side), np.flatnonzero(~side)))
        links = np.zeros(len(left), np.int64)
        known, code = np.unique(rep, return_inverse=True)
        group = np.arange(len(known))
        a, b = [], []
        for lo in range(0, len(left), 256):
            part = left[lo : lo + 256]
            within = right[np.searchsorted(angle[right], angle[part[0]] - reach) : np.searchsorted(angle[right], angle[part[-1]] + reach, side="right")]
            near = u[part] @ u[within].T >= threshold
            near &= (rep[part][:, None] != rep[within]) | (h1[part][:, None] != h1[within])
            links[lo : lo + 256] = near @ m[within]
            for x, hits in zip(part, near, strict=True):
                to = code[within[hits]]
                other = group[to]
                new, first = np.unique(other[other != group[code[x]]], return_index=True)
                if len(new):
                    a.append(np.full(len(new), rep[x]))
                    b.append(known[to[other != group[code[x]]][first]])
                    group[np.isin(group, new)] = group[code[x]]
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        n, k = len(left), len(a)
        own = lambda x, kind=np.int64: pa.array(np.concatenate([x, np.zeros(k, kind)]))
        edge = lambda x: pa.array(np.concatenate([np.zeros(n, np.int64), x]))
        return pa.table({"rep": own(rep[left]), "h1": own(h1[left]), "links": own(links), "a": edge(a), "b": edge(b)})

    found = cut(blocks.groupBy("part", "cell", "i", "j").applyInArrow(join, "rep long, h1 long, links long, a long, b long"))
    degree = found.groupBy("rep", "h1").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("a <> b").select("a", "b"))
    of = classes.select("h1", "h2", "rep", "m").join(degree, ["rep", "h1"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = rows.where("ok").join(of, ["h1", "h2"], "left").select("vec_id", "n_links", F.col("root").alias("component_id"))
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
