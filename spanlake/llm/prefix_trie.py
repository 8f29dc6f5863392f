"""Trie of conversation prefixes: union-find over the common prefixes of sorted neighbours, in descending depth.

A conversation is the run of its turns' digests, 20 bytes a turn (MD5 of role and text, and the text's length); equal
conversations are one sequence with a count. Sequences are dealt by range and sorted, so that the members of every node
lie side by side. In a partition each sequence starts as a component; the edges between neighbours, deepest common
prefix first, merge components, and a merge below their own depth creates a branching node. Nodes without branches
between two of them need no component: they share the members of the next deeper one.

A node that holds neither the first nor the last sequence of its partition is complete. The others are prefixes of
these two sequences and may go on in the next partition: they are given out depth by depth, with what hangs below them
contracted to sums, and forests meet by adding up the rows of equal prefixes. Sums over a subtree then run up the paths,
each shared node counted on one of them.

Defined results: rows without conv_id are left out; a null role or text is empty; turns that tie are ordered by the
digest of role and text; repeated rows are turns of their own; no conversations give an empty table, a conversation
without turns ends at the root. A conversation's digests are one value, 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import cut, quoted, small
from spanlake.storage import shared_folder

#: Bytes of a turn in a sequence; the last four are its text's length.
TURN = 20
#: Identifiers of one end are joined in blocks of this many consecutive numbers before they are hashed in order.
SHIFT = 12
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """40 hexadecimal digits: MD5 of role and text, and how many characters the text has."""
    both = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.md5(both), F.lpad(F.lower(F.hex(F.char_length(text))), 8, "0"))


def conversations_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's turn digests in order."""
    c, t, r, x = quoted([conv_id, turn, role, text])
    digest = turn_digest(F.coalesce(r.cast("string"), F.lit("")), F.coalesce(x.cast("string"), F.lit("")))
    one = F.struct(t.isNotNull().alias("known"), F.coalesce(t.cast("long"), F.lit(0)).alias("turn"), digest.alias("digest"))
    rows = turns.where(c.isNotNull()).select(c.cast("long").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("ones")).select("conv_id", F.col("ones.digest").alias("turns"))


def share_openings(conversations: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Each conversation opens with the first turns of the one whose number is the last multiple of ``every``.

    How many, 0 to ``most``, is drawn from the CRC of its number; they take the place of as many turns of its own.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    heads = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("leader"), F.slice("turns", 1, most).alias("head"))
    own = conversations.withColumn("h", h).withColumn("leader", F.col("conv_id") - F.col("conv_id") % every)
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<string>"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "leader", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b)) // TURN * TURN
    if a[:m] == b[:m]:
        return m // TURN
    return int(np.argmax(np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m))) // TURN


def text_lengths(sequence: bytes) -> np.ndarray:
    return np.frombuffer(sequence, np.uint8).reshape(-1, TURN)[:, TURN - 4 :].copy().view(">u4").ravel().astype(np.int64)


def prefix_keys(sequence: bytes) -> list[str]:
    """MD5 of the first 0, 1, 2 ... turns."""
    digest, keys = hashlib.md5(), []
    for at in range(0, len(sequence) + 1, TURN):
        keys.append(digest.hexdigest())
        digest.update(sequence[at : at + TURN])
    return keys


_FOREST = {
    "path": pa.int64(), "key": pa.string(), "depth": pa.int64(), "parent_key": pa.string(), "parent_conv_id": pa.int64(), "conv_id": pa.int64(),
    "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "size": pa.int64(), "ends": pa.bool_(),
}
_FOREST_DDL = "path long, key string, depth long, parent_key string, parent_conv_id long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends boolean"


class Forest:
    """Components of one sorted partition. ``add`` takes its sequences in order, ``rows`` gives all nodes."""

    def __init__(self) -> None:
        self.first = self.last = None
        self.lcps: list[int] = []
        self.sizes: list[np.ndarray] = []  # text lengths of the nodes that a sequence has and its forerunner has not
        self.keys: list[str] = []
        # of each component's node: a sequence's own first, then those that merges create
        self.depth: list[int] = []
        self.n: list[int] = []
        self.smallest: list[int] = []

    def add(self, sequence: bytes, n: int, smallest: int) -> None:
        lcp = 0 if self.last is None else common_turns(self.last, sequence)
        self.first = sequence if self.first is None else self.first
        self.last = sequence
        self.lcps.append(lcp)
        self.sizes.append(text_lengths(sequence[lcp * TURN :]))
        self.keys.append(hashlib.md5(sequence).hexdigest())
        self.depth.append(len(sequence) // TURN)
        self.n.append(n)
        self.smallest.append(smallest)

    def rows(self, partition: int) -> Iterator[dict[str, np.ndarray | list]]:
        m = len(self.lcps)
        if not m:
            return
        self._merge()
        starts = np.append(0, np.cumsum([len(s) + 1 for s in self.sizes]))
        upto = np.zeros(starts[-1], np.int64)  # text lengths summed from a sequence's first own node on
        for at, s in zip(starts, self.sizes, strict=False):
            upto[at + 1 : at + 1 + len(s)] = np.cumsum(s)
        lcps = np.array(self.lcps)
        depth, n, smallest, left, right, parent = (np.array(x, np.int64) for x in (self.depth, self.n, self.smallest, self.left, self.right, self.parent))
        kids, leaves, below = (np.zeros(len(depth), np.int64) for _ in range(3))
        above = np.where(parent >= 0, depth[parent], -1)
        complete = (left > 0) & (right < m - 1) & ~self.absorbed
        total = lambda i, d: upto[starts[left[i]] + d - lcps[left[i]]]
        for i in np.lexsort((-depth,)):  # deepest first
            if complete[i]:
                leaves[i] = leaves[i] or 1
                p = parent[i]
                kids[p] += 1
                leaves[p] += leaves[i]
                below[p] += below[i] + (n[i] - 1) * (total(i, depth[i]) - total(i, above[i]))
        firsts, lasts = prefix_keys(self.first), prefix_keys(self.last)
        yield from self._complete(np.flatnonzero(complete), depth, above, parent, n, smallest, left, kids, leaves, below, starts, upto, lcps, complete, firsts, lasts)
        whole = (left == 0) & (right == m - 1) & ~self.absorbed
        sides = [(2 * partition, (left == 0) & ~self.absorbed, firsts, text_lengths(self.first), -1)]
        if m > 1:
            sides.append((2 * partition + 1, (right == m - 1) & ~self.absorbed, lasts, text_lengths(self.last), int(depth[whole][0])))
        for path, mask, keys, sizes, shared in sides:
            held = np.flatnonzero(mask)
            held = held[np.argsort(depth[held])]
            d = np.arange(len(keys))
            node = held[np.searchsorted(depth[held], d)]
            here, own = d > shared, (d > shared) & (depth[node] == d)
            yield {
                "path": np.full(len(d), path), "key": keys, "depth": d, "parent_key": [None, *keys[:-1]], "parent_conv_id": [None] * len(d),
                "conv_id": [int(s) if h else None for s, h in zip(smallest[node], here, strict=True)], "n_convs": np.where(here, n[node], 0), "n_children": np.where(own, kids[node], 0),
                "n_leaves": np.where(own, leaves[node], 0), "saved_tokens": np.where(own, below[node], 0), "size": np.append(0, sizes), "ends": own & self.ends[node],
            }

    def _merge(self) -> None:
        """Unites neighbours by their edges in descending depth; records each node's range, parent and whether a sequence ends there."""
        m = len(self.lcps)
        root, top = list(range(m)), list(range(m))  # union-find over sequences; the node that a component is now
        self.left, self.right, self.parent = list(range(m)), list(range(m)), [-1] * m
        ends, absorbed = [True] * m, [False] * m

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for edge in sorted(range(1, m), key=lambda i: -self.lcps[i]):
            d, a, b = self.lcps[edge], find(edge - 1), find(edge)
            x, y = top[a], top[b]
            if self.depth[x] > d and self.depth[y] > d:
                node = len(self.depth)
                self.depth.append(d)
                self.n.append(0)
                self.smallest.append(min(self.smallest[x], self.smallest[y]))
                self.left.append(self.left[x])
                self.right.append(self.right[y])
                self.parent.append(-1)
                ends.append(False)
                absorbed.append(False)
            else:
                node = x if self.depth[x] == d else y
            for z in (x, y):
                if z == node:
                    continue
                self.n[node] += self.n[z]
                self.smallest[node] = min(self.smallest[node], self.smallest[z])
                if self.depth[z] == d:  # the same node, met from both sides
                    absorbed[z], ends[node] = True, ends[node] or ends[z]
                self.parent[z] = node
            self.left[node], self.right[node] = self.left[x], self.right[y]
            root[b] = a
            top[a] = node
        for z in range(len(self.depth)):  # children of a node that was absorbed belong to the one that took it in
            p = self.parent[z]
            while p >= 0 and absorbed[p]:
                p = self.parent[p]
            self.parent[z] = p
        self.ends, self.absorbed = np.array(ends), np.array(absorbed)

    def _complete(self, nodes, depth, above, parent, n, smallest, left, kids, leaves, below, starts, upto, lcps, complete, firsts, lasts) -> Iterator[dict]:
        """A row for each depth that a complete node stands for, some ten thousand rows at a time.

        The sequence that ends at a node, if one does, is the first of its range: a prefix sorts before what it begins.
        """
        counts = depth[nodes] - above[nodes]
        for lot in np.split(nodes, np.flatnonzero(np.diff(np.cumsum(counts) // 10_000)) + 1) if len(nodes) else []:
            many = depth[lot] - above[lot]
            i = np.repeat(lot, many)
            d = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + above[i] + 1
            at = starts[left[i]] - lcps[left[i]]
            last, top = d == depth[i], d == above[i] + 1
            p = parent[i]
            outside = top & ~complete[p]
            yield {
                "path": [None] * len(i), "key": [self.keys[j] if e else None for j, e in zip(left[i], last & self.ends[i], strict=True)], "depth": d,
                "parent_key": [(firsts if left[q] == 0 else lasts)[e - 1] if o else None for q, e, o in zip(p, d, outside, strict=True)],
                "parent_conv_id": [None if o else int(s) for o, s in zip(outside, np.where(top, smallest[p], smallest[i]), strict=True)],
                "conv_id": smallest[i], "n_convs": n[i], "n_children": np.where(last, kids[i], 1), "n_leaves": leaves[i],
                "saved_tokens": below[i] + (n[i] - 1) * (upto[at + depth[i]] - upto[at + d - 1]), "size": np.zeros(len(i), np.int64), "ends": last & self.ends[i],
            }


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for sequence, n, smallest in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            forest.add(sequence, n, smallest)
    for rows in forest.rows(TaskContext.get().partitionId()):
        yield pa.record_batch({k: pa.array(rows[k], kind) for k, kind in _FOREST.items()})


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order; nothing but the running hash is held."""
    now, digest = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.record_batch({"key": pa.array([k for k, _ in done], pa.string()), "ends_sha256": pa.array([s for _, s in done], pa.string())})
    if now is not None:
        yield pa.record_batch({"key": [now], "ends_sha256": [digest.hexdigest()]})


def ends_of(sequences: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the hash of the ascending numbers of the conversations that are a sequence."""
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = sequences.groupBy(F.md5("seq").alias("key"), F.shiftright("conv_id", SHIFT).alias("block")).agg(numbers.alias("piece"))
    return blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "piece").mapInArrow(_joined_ends, "key string, ends_sha256 string")


def _merged(open_: DataFrame) -> DataFrame:
    """Nodes on the edges of partitions, their rows added up."""
    nodes = cut(open_.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("kids"), F.max("size").alias("size"), F.max("ends").alias("ends"), F.min("path").alias("owner"),
    ))
    more = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(more, "key", "left").withColumn("n_children", F.col("kids") + F.coalesce("more", F.lit(0)))
    mine = nodes.select("key", "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    up = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    once = lambda c: F.when(F.col("owner") == F.col("path"), F.col(c)).otherwise(0)
    rows = open_.join(mine, "key").select("path", "depth", "key", (F.col("n_leaves") + once("leaf")).alias("n_leaves"), (F.col("saved_tokens") + once("saved")).alias("saved"))
    sums = rows.select("key", F.sum("n_leaves").over(up).alias("n_leaves"), F.sum("saved").over(up).alias("saved"))
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return cut(nodes.join(sums, "key").join(parents, "parent_key", "left"))


def build(conversations: DataFrame) -> DataFrame:
    """Every node of the trie over ``conv_id, turns``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    sequences = cut(conversations.select("conv_id", F.unhex(F.array_join("turns", "")).alias("seq")))
    distinct = sequences.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("smallest"))
    ranged = distinct.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq").sortWithinPartitions("seq")
    folder = shared_folder(spark, "prefixes")
    ranged.mapInArrow(_forests, _FOREST_DDL).write.parquet(folder)
    forest = spark.read.schema(_FOREST_DDL).parquet(folder)
    edge = _merged(forest.where("path IS NOT NULL"))
    inner = forest.where("path IS NULL")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "key", "ends"]
    heads = small(edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found")))
    topmost = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(heads, "parent_key").withColumnRenamed("found", "parent_conv_id")
    nodes = edge.select(*names).union(inner.where("parent_key IS NULL").select(*names)).union(topmost.select(*names))
    ended = nodes.where("ends").join(ends_of(sequences), "key")
    out = [*names[:-2], "ends_sha256"]
    return ended.select(*out).union(nodes.where("NOT ends").withColumn("ends_sha256", F.lit(EMPTY_SHA)).select(*out))
