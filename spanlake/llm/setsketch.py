"""Near-duplicate documents: SetSketch registers, banded candidates, joint likelihood, exact verification.

A document's set holds its distinct five-word shingles. The sketch of a set has ``BANDS * ROWS`` registers; each is an
exponentially spaced, truncated minimum ``clamp(floor(1 - log_b(x / a)), 0, q + 1)`` of exponential variates of the
elements, so the sketch of a union is the larger value of each register. Sets that agree on a whole band meet in a
bucket. Members of a bucket are first compared with two centres. Buckets that then hold more than one component are
compared in full, in blocks of bounded size: a first pass keeps the rows whose registers make a link to another component
plausible, a second compares their full sets and returns a forest of the links between components, so none is lost and
no block returns more rows than it has. Candidates pass a joint likelihood test over their registers and are confirmed
on the full sets: a centre's members are dealt into blocks, and its text goes once to each. Texts are read as bytes, so
invalid UTF-8 is compared as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import band, cut, keep_ids, quoted, slices, small, small_batches
from spanlake.llm.components import connected_components
from spanlake.llm.pieces import gather

WORDS = 5
#: A pair at the least threshold in use, 0.8, shares no band with probability (1 - 0.8**5)**38 < 3e-7.
BANDS, ROWS = 38, 5
#: Register spacing, rate and largest value.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: A pair is let go before verification only if the likelihood at the threshold is below exp(-LEEWAY) of the largest.
LEEWAY = 20.0
#: Text bytes that are hashed at once, and rows and shingles of one side of a block comparison, which bound a task's memory.
CHUNK, BLOCK, SHINGLES = 1 << 20, 2048, 1 << 20
#: Members of a centre that are confirmed together; its text goes once to each such group.
MEMBERS = 256

_RANDOM = np.random.default_rng(20240229)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTES = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)[_FOLD]
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_STEP = int(_RANDOM.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_PLACE = _RANDOM.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _RANDOM.integers(0, 2**64, WORDS, dtype=np.uint64)
_XOR = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _STEP, np.uint64), np.full(n + 1, pow(_STEP, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct shingle hashes of texts; powers of the polynomial are kept between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct 64-bit shingle hashes of all texts, and where each text's begin (one more at the end)."""
        parts = [self._some(texts[lo:hi]) for lo, hi in _chunks(texts)]
        sizes = [np.zeros(1, np.int64), *(np.diff(at) for _, at in parts)]
        return np.concatenate([np.empty(0, np.uint64), *(x for x, _ in parts)]), np.cumsum(np.concatenate(sizes))

    def _some(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``sets`` for texts of about ``CHUNK`` bytes: a byte takes some fifty while its text is hashed."""
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if len(data) >= len(self.up):
            self.up, self.down = _powers(len(data) + CHUNK // 4)
        inside = np.empty(len(data) + 1, bool)
        inside[0] = False
        np.logical_not(_SPACE[data], out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.up[: len(data)], dtype=np.uint64)])
        words = _mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        first = np.searchsorted(start, offsets)  # of each text, its first word
        n = np.diff(first)
        owner = np.repeat(np.arange(len(texts)), n)
        count = len(words) - WORDS + 1
        if count > 0:
            shingles = np.zeros(count, np.uint64)
            for i in range(WORDS):
                shingles += words[i : i + count] * _PLACE[i]
            whole = owner[:count] == owner[WORDS - 1 :]
            shingles, owner = _mix(shingles[whole]), owner[:count][whole]
        else:
            shingles, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        few = np.flatnonzero((n > 0) & (n < WORDS))
        if len(few):
            short = [_mix(np.sum(words[first[i] : first[i + 1]] * _PLACE[: n[i]], keepdims=True, dtype=np.uint64) + _SHORT[n[i]])[0] for i in few]
            shingles, owner = np.concatenate([shingles, np.array(short, np.uint64)]), np.concatenate([owner, few])
        out, sizes = [], np.zeros(len(texts) + 1, np.int64)
        order = np.argsort(owner, kind="stable") if len(few) else slice(None)
        shingles, at = shingles[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        for i in range(len(texts)):
            own = np.sort(shingles[at[i] : at[i + 1]])
            if len(own):
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            out.append(own)
            sizes[i + 1] = len(own)
        return np.concatenate(out) if out else np.empty(0, np.uint64), np.cumsum(sizes)


def registers(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (uint16, sets by registers) of the non-empty sets ``shingles[at[i]:at[i + 1]]``."""
    least = np.empty((len(at) - 1, BANDS * ROWS), np.uint64)
    if len(least):
        for i in range(BANDS * ROWS):
            least[:, i] = np.minimum.reduceat((shingles ^ _XOR[i]) * _TIMES[i], at[:-1])
    x = -np.log1p(-((least.astype(np.float64) + 0.5) / 2.0**64).clip(2.0**-64, 1 - 2.0**-53))
    return np.clip(np.floor(1 - np.log(x / RATE) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge_registers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(left, right)


def plausible(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float, leeway: float = LEEWAY) -> np.ndarray:
    """Whether similarity at or above ``threshold`` is plausible for pairs of sketches of sets of ``n`` and ``m`` elements.

    The joint likelihood of the numbers of registers that are greater, smaller and equal is taken over a grid of
    similarities; a pair passes if some value from the threshold on comes within ``exp(-leeway)`` of the best.
    """
    more, less = (left > right).sum(1)[:, None], (left < right).sum(1)[:, None]
    same = left.shape[1] - more - less
    u = (n / (n + m))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)  # the similarity can't exceed the ratio of the sizes
    grid = np.linspace(0, 1, 101)[None, :]
    scale = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        above, below = p(u - v * j).clip(1e-12), p(v - u * j).clip(1e-12)
        return more * np.log(above) + less * np.log(below) + same * np.log((1 - above - below).clip(1e-12))

    best = likelihood(grid * top).max(1)
    span = np.maximum(top - threshold, 0)
    return (top[:, 0] >= threshold - 1e-9) & (likelihood(threshold + np.linspace(0, 1, 21)[None, :] * span).max(1) >= best - leeway)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in slices(batches, 1, CHUNK):
        shingles, at = shingler.sets([t or b"" for t in batch.column(1).to_pylist()])
        n = np.diff(at)
        full = n > 0
        starts = np.concatenate([at[:-1][full], at[-1:]])
        regs = registers(shingles, starts)
        prints = np.zeros((2, len(n)), np.uint64)
        if len(regs):
            prints[0, full] = np.add.reduceat(_mix(shingles ^ _SHORT[0]), starts[:-1])
            prints[1, full] = np.add.reduceat(_mix(shingles + _SHORT[1]), starts[:-1])
        rows = iter(regs)
        sketches = [next(rows).tobytes() if x else None for x in full]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.array(sketches, pa.binary())], ["doc_id", "n", "f1", "f2", "regs"])


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, set size ``n``, 128-bit set fingerprint ``f1``, ``f2`` and registers ``regs`` (null for an empty set)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return small_batches(rows).mapInArrow(_sketch, "doc_id long, n long, f1 long, f2 long, regs binary")


def _likely(threshold: float):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 5))
                n, m = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(plausible(left, right, n, m, threshold)))

    return test


def _confirmed(percent: int):
    """Rows sorted by ``a``, ``h``, ``chunk``, each block's centre first (``b`` is null): the members that it links to."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        centre = np.empty(0, np.uint64)
        for batch in slices(batches, 4):
            shingles, at = shingler.sets([t or b"" for t in batch.column(4).to_pylist()])
            first = pc.is_null(batch.column(3)).to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                own = shingles[at[i] : at[i + 1]]
                if first[i]:
                    centre = own
                elif len(own) and len(centre):
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(centre) + len(own) - both)
            yield batch.select([0, 3]).filter(pa.array(keep))

    return test


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``rep``, ``h`` and ``text`` for the ids of one column: each different text once (an id may be repeated)."""
    found = keep_ids(texts, "rep", ids).withColumn("h", F.xxhash64("text"))
    return cut(found.dropDuplicates(["rep", "h"]))


def _confirm(likely: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``likely`` (``a``: centre, ``b``: member, class ids) that the full sets confirm."""
    found = _texts_of(likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), texts)
    large = likely.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("chunks")).where("chunks > 1")
    dealt = likely.join(small(cut(large)), "a", "left")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"), F.lit(None).cast("long").alias("h"))
    several = cut(found.groupBy(F.col("rep").alias("a")).agg(F.count("*").alias("n")).where("n > 1").select("a"))
    if not several.isEmpty():  # ids with different texts: a block for each text of a centre
        texts_of = keep_ids(found.withColumnRenamed("rep", "a"), "a", several).select("a", "h")
        dealt = keep_ids(dealt, "a", several, "left_anti").unionByName(keep_ids(dealt, "a", several).drop("h").join(texts_of, "a"))
    dealt = cut(dealt)
    columns = ["a", "h", "chunk", "b", "text"]
    heads = dealt.select("a", "h", "chunk").distinct().join(found.select(F.col("rep").alias("a"), F.col("h").alias("of"), "text").hint("merge"), "a").where("h is null or h = of")
    members = dealt.join(found.select(F.col("rep").alias("b"), "text").hint("merge"), "b")
    rows = heads.withColumn("b", F.lit(None).cast("long")).select(columns).unionAll(members.select(columns))
    rows = rows.repartition("a", "h", "chunk").sortWithinPartitions("a", "h", "chunk", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_confirmed(percent), "a long, b long")


def _by_block(columns: tuple[str, ...], schema: pa.Schema, found):
    """A mapper over rows sorted by ``bucket, i, j``: calls ``found`` with each block's rows, left and right side."""

    def block(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        chunk, i, j = (rows.column(k).to_numpy() for k in ("chunk", "i", "j"))
        left = np.flatnonzero(chunk == i)
        out = found(rows, left, left if i[0] == j[0] else np.flatnonzero(chunk == j))
        if out is not None and len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # parts of the block that has not ended yet
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in ("bucket", "i", "j")])
            at = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                key = tuple(keys[:, lo])
                if held and key != last:
                    yield from block(pa.concat_batches(held))
                    held = []
                last = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from block(pa.concat_batches(held))

    return run


_BLOCK = ("bucket", "i", "j", "chunk", "rep", "root")


def _promising(percent: int):
    """Rows of a block that have a plausible partner in another component; at most as many as there are."""

    def found(rows: pa.RecordBatch, left: np.ndarray, right: np.ndarray):
        root, n = rows.column("root").to_numpy(), rows.column("n").to_numpy()
        regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(len(root), -1)
        t, k = percent / 100, regs.shape[1]
        most = k * t - 10 * np.sqrt(k * t * (1 - t))  # equal registers: ten standard deviations below what the threshold gives
        flag = np.zeros(len(root), bool)
        for k, x in enumerate(left):
            y = right[k + 1 :] if right is left else right
            y = y[(root[y] != root[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            if flag[x]:
                y = y[~flag[y]]
            if len(y):
                y = y[np.count_nonzero(regs[y] == regs[x], axis=1) >= most]
            if len(y):
                y = y[plausible(np.broadcast_to(regs[x], (len(y), regs.shape[1])), regs[y], np.full(len(y), float(n[x])), n[y].astype(float), percent / 100)]
                flag[y] = True
                flag[x] |= len(y) > 0
        return [rows.column(k).to_numpy()[flag] for k in _BLOCK]

    return _by_block(_BLOCK, pa.schema([(k, pa.int32() if k in ("i", "j", "chunk") else pa.int64()) for k in _BLOCK]), found)


def _exact(percent: int):
    """A forest of the links between components of a block, from the full sets."""

    def found(rows: pa.RecordBatch, left: np.ndarray, right: np.ndarray):
        rep = rows.column("rep").to_numpy()
        shingles, at = Shingler().sets([t or b"" for t in rows.column("text").to_pylist()])
        n = np.diff(at)
        known, code = np.unique(shingles, return_inverse=True)
        seen = np.zeros(len(known), np.int64)
        _, group = np.unique(rows.column("root").to_numpy(), return_inverse=True)
        a, b = [], []
        for k, x in enumerate(left):
            y = right[k + 1 :] if right is left else right
            y = y[(group[y] != group[x]) & (n[y] > 0) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            if not len(y):
                continue
            seen[code[at[x] : at[x + 1]]] = 1
            both = np.add.reduceat(seen[gather(code, at[y], n[y])], np.cumsum(n[y]) - n[y])
            seen[code[at[x] : at[x + 1]]] = 0
            for z in y[100 * both >= percent * (n[y] + n[x] - both)]:
                if group[z] != group[x]:
                    a.append(min(rep[x], rep[z]))
                    b.append(max(rep[x], rep[z]))
                    group[group == group[z]] = group[x]
        return np.array(a, np.int64), np.array(b, np.int64)

    return _by_block((*_BLOCK, "text"), pa.schema([("a", pa.int64()), ("b", pa.int64())]), found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct five-word shingles;
    ``component_id`` is the smallest id that links reach, ``kept`` whether it is the row's own. Null and empty texts,
    and texts without words, have an empty set and are linked with nothing. Rows with a null id are linked with nothing:
    their ``component_id`` is null and they are kept. Rows that repeat an id count as one document: it has the links of
    all its texts. Sets are compared by 64-bit hashes of their shingles, equal sets are found by 128-bit fingerprints.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sketches = cut(sketch(rows))
    own = ["f1", "f2", "n"]
    classes = cut(sketches.where("n > 0 and doc_id is not null").groupBy(*own).agg(F.min("doc_id").alias("rep"), F.any_value("regs").alias("regs")))
    texts = rows.withColumnRenamed("doc_id", "rep")
    buckets = classes.select("rep", "n", F.explode(F.array(*[band(F.col("regs"), i, 2 * ROWS) for i in range(BANDS)])).alias("bucket"))
    centre = lambda *key: F.min(F.struct(*key, "rep", "n"))
    shared = buckets.groupBy("bucket").agg(centre().alias("c"), centre(F.xxhash64("rep").alias("h")).alias("d"), F.max("rep").alias("most")).where("c.rep < most")
    members = cut(buckets.join(shared.select("bucket", "c", F.struct("d.rep", "d.n").alias("d")).hint("merge"), "bucket"))
    stars = members.select("rep", "n", F.explode(F.array("c", "d")).alias("c")).where("rep <> c.rep")
    stars = stars.where(f"100 * least(n, c.n) >= {int(percent)} * greatest(n, c.n)").select(F.least("rep", "c.rep").alias("lo"), F.greatest("rep", "c.rep").alias("hi"), "c.rep")
    stars = stars.groupBy("lo", "hi").agg(F.min("rep").alias("a")).select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
    left, right = (classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("regs").alias(f"regs_{k}")) for k in "ab")
    stars = stars.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    many = sketches.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("doc_id")
    many = sketches.join(many.hint("merge"), "doc_id").join(classes.select(*own, "rep").hint("merge"), own).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = cut(_confirm(cut(stars.mapInArrow(_likely(percent / 100), "a long, b long")), texts, percent).unionAll(many))
    # the least that a document is linked to in two steps: pairs that share it need no further look
    near = links.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("to")), F.struct(F.col("b").alias("rep"), F.col("a").alias("to")))).alias("e")).groupBy("e.rep").agg(F.min("e.to").alias("to"))
    near = near.join(near.toDF("to", "on").hint("merge"), "to").select("rep", F.least("to", "on").alias("to"))
    placed = members.select("bucket", "rep", "n").join(near.hint("merge"), "rep", "left").withColumn("root", F.least("rep", "to"))
    apart = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k"), F.sum("n").alias("size")).where("lo < hi")
    chunks = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("size") / SHINGLES)).cast("int").alias("chunks")
    open_ = placed.join(apart.select("bucket", chunks).hint("merge"), "bucket").join(classes.select("rep", "n", "regs").hint("merge"), ["rep", "n"])
    open_ = open_.withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    open_ = open_.select("bucket", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "chunk", "rep", "root", "n", "regs")
    dealt = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    hopeful = cut(dealt(open_).mapInArrow(_promising(percent), "bucket long, i int, j int, chunk int, rep long, root long"))
    with_text = hopeful.join(_texts_of(hopeful.select("rep").distinct(), texts).drop("h").hint("merge"), "rep").select(*_BLOCK, "text")
    more = cut(dealt(with_text).mapInArrow(_exact(percent), "a long, b long"))
    roots = connected_components(links.unionAll(more))
    of = classes.select(*own, F.col("rep").alias("node"))
    of = of.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    out = sketches.select("doc_id", *own).join(of.select(*own, "root").hint("merge"), own, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` (all its columns) with one document of each group of near-duplicates: the one with the smallest id.

    Rows with a null id stay. Of rows that repeat an id one stays.
    """
    gone = near_duplicates(docs, percent=percent).where("not kept").select("doc_id").distinct()
    left = keep_ids(docs, "doc_id", cut(gone), "left_anti").select(quoted(docs.columns))
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    columns = quoted(docs.columns)
    return keep_ids(left, "doc_id", again, "left_anti").select(columns).unionAll(keep_ids(left, "doc_id", again).dropDuplicates(["doc_id"]).select(columns))
