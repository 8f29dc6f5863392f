"""Edit-aware token counts: a segment tree over a document's pre-tokens.

Each leaf holds the tokens of one pre-token, each inner node the sum of its children. An edit replaces a span of text:
only pre-tokens that the edit touches, and a little context before them, are split and encoded again. Splitting starts
at a boundary whose match can't have seen the edit and ends where a new boundary meets an old one beyond it; from there
on matches are the same, because the pattern never looks back. The affected leaves are set and the sums above them
updated; the root is the new count. Trees are built once and kept as a table; edits are a table too and meet the trees
by id and version, so only documents that are edited are read again.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import cut, keep_ids, slices, small_batches
from spanlake.storage import shared_folder

#: Characters past its end that the default pattern may have examined for a match.
LOOKAHEAD = 4
#: Different pre-tokens whose counts a worker keeps.
KEPT = 500_000
#: (start, end, replacement) over code points of the text as it was, ascending and without overlap.
Edits = list[tuple[int, int, str]]


def default_vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pattern of pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Splits texts into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str, pattern: str, lookahead: int | None = None) -> None:
        """``lookahead``: characters past its end that ``pattern`` may examine for a match; known for the default pattern."""
        if lookahead is None and pattern != default_vocabulary()[1]:
            raise ValueError("say how many characters past a match this pattern may examine")
        self.lookahead = LOOKAHEAD if lookahead is None else lookahead
        self.encoding, self.pattern = _encoding(path, pattern), regex.compile(pattern)
        self.kept: dict[str, int] = {}

    def counts(self, tokens: list[str]) -> list[int]:
        new = set(tokens).difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = set(tokens)
        encode = self.encoding.encode_ordinary
        for t in new:
            self.kept[t] = len(encode(t))
        return list(map(self.kept.__getitem__, tokens))


class Tree:
    """Sums over slots; a slot is one pre-token of the text as it was, and slot 0 takes what is inserted before the first."""

    def __init__(self, leaves: list[int]) -> None:
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = np.zeros(2 * self.size, np.int64)
        self.sums[self.size : self.size + len(leaves)] = leaves
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @classmethod
    def of(cls, sums: np.ndarray) -> Tree:
        """The tree with these sums."""
        tree = cls.__new__(cls)
        tree.size, tree.sums = len(sums) // 2, np.array(sums, np.int64)
        return tree

    def set(self, first: int, last: int, value: int) -> None:
        """Slots ``first`` to ``last`` (exclusive) become zero but for ``value`` in the first; their ancestors follow."""
        lo, hi = first + self.size, last + self.size
        self.sums[lo:hi] = 0
        self.sums[lo] = value
        lo, hi = lo // 2, (hi - 1) // 2
        while lo:
            self.sums[lo : hi + 1] = self.sums[2 * lo : 2 * hi + 2 : 2] + self.sums[2 * lo + 1 : 2 * hi + 2 : 2]
            lo, hi = lo // 2, hi // 2

    def total(self) -> int:
        return int(self.sums[1])


def _resplit(counter: Counter, text: str, edits: Edits, k: int, base: int, starts: list[int]) -> tuple[list[str], int, int]:
    """New pre-tokens from old boundary ``base`` on, the old slot where they meet the rest, and the next edit's number."""
    reach = 64
    while True:
        parts, at, j = [], base, k
        while j == k or (j < len(edits) and edits[j][0] <= at + reach):  # edits close to each other go together
            parts += [text[at : edits[j][0]], edits[j][2]]
            at, j = edits[j][1], j + 1
        stop = min(len(text), at + reach)
        ended = stop == len(text)
        new = "".join([*parts, text[at:stop]])
        untouched, shift = len(new) - (stop - at), stop - len(new)
        fresh = []
        for m in counter.pattern.finditer(new):
            if m.start() >= untouched and (ended or m.start() + counter.lookahead <= len(new)):
                slot = bisect_left(starts, m.start() + shift)
                if slot < len(starts) and starts[slot] == m.start() + shift:
                    return fresh, slot, j
            if not ended and m.end() + counter.lookahead > len(new):
                break
            fresh.append(m.group())
        else:
            if ended:
                return fresh, len(starts) - 1, j
        reach *= 4


def apply(counter: Counter, text: str, edits: Edits, starts: list[int], tree: Tree) -> int:
    """Updates the tree of ``text``, whose pre-tokens end at ``starts[1:]``; pre-tokens that were split and encoded again."""
    redone = k = 0
    while k < len(edits):
        # pre-tokens that end so far before the edit can't have seen it
        first = min(bisect_right(starts, max(0, edits[k][0] - counter.lookahead), 1) - 1, max(len(starts) - 2, 0))
        fresh, last, k = _resplit(counter, text, edits, k, starts[first], starts)
        redone += len(fresh)
        value = sum(counter.counts(fresh))
        if last > first:
            tree.set(first + 1, last + 1, value)
        else:
            tree.set(0, 1, value + int(tree.sums[tree.size]))
    return redone


def recount(counter: Counter, text: str, edits: Edits) -> tuple[int, int, int, int]:
    """Tokens before and after the edits, pre-tokens before, and pre-tokens that were split and encoded again."""
    tokens = counter.pattern.findall(text)
    tree = Tree([0, *counter.counts(tokens)])
    before = tree.total()
    redone = apply(counter, text, edits, [0, *np.cumsum([len(t) for t in tokens]).tolist()], tree)
    return before, tree.total(), len(tokens), redone


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def _versioned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``version`` (hash of the text) and ``text`` as bytes."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))


def _decoded(batch: pa.RecordBatch, column: int) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in batch.column(column).to_pylist()]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None, lookahead: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``version``, ``n_tokens``, ``n_pretokens``, ``sizes``, ``sums``.

    ``sizes`` are the characters of each pre-token, ``sums`` the segment tree (root at 1, leaves in the second half). A
    null or empty text has an empty tree. Repeated and null ids are kept; other columns are left out.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern, lookahead)
        for batch in slices(batches, 2):
            sizes, sums = [], []
            for text in _decoded(batch, 2):
                tokens = counter.pattern.findall(text)
                sizes.append(np.fromiter(map(len, tokens), np.int32, len(tokens)))
                sums.append(Tree([0, *counter.counts(tokens)]).sums)
            totals = [pa.array([f(x) for x in c], pa.int64()) for f, c in ((lambda x: int(x[1]), sums), (len, sizes))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *totals, _lists(sizes, pa.int32()), _lists(sums, pa.int64()).cast(pa.list_(pa.int32()))], ["doc_id", "version", "n_tokens", "n_pretokens", "sizes", "sums"])

    return small_batches(_versioned(docs, id_col, text_col)).mapInArrow(run, "doc_id long, version long, n_tokens long, n_pretokens long, sizes array<int>, sums array<int>")


_EDITS = "array<struct<start: int, end: int, new: string>>"


def count_after_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None, lookahead: int | None = None) -> DataFrame:
    """One row per row of ``trees``: ``doc_id``, ``n_edits``, ``n_before``, ``n_after``, ``n_pretokens``, ``n_redone``.

    ``trees`` are those of ``build_trees(docs)``; ``edits`` has ``doc_id``, ``version`` and ``edits`` (``start``, ``end``,
    ``new``: code points of the text as it was, ascending, without overlap), one row for a text. ``n_after`` equals the
    count of the edited text encoded from scratch. A null or empty text has no tokens before; edits of it are insertions
    at 0. Edits of another version of a text, or of ids that ``docs`` doesn't have, change nothing. Repeated and null ids
    are kept; an empty table gives no rows.
    """
    path, pattern = vocabulary or default_vocabulary()
    columns = ["doc_id", "version", "n_edits", "n_after", "n_redone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern, lookahead)
        for batch in slices(batches, 2):
            rows = []
            for text, made, sizes, sums in zip(_decoded(batch, 2), *(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                changes = [(e["start"], e["end"], e["new"] or "") for e in made]
                tree = Tree.of(sums)
                redone = apply(counter, text, changes, [0, *np.cumsum(sizes, dtype=np.int64).tolist()], tree)
                rows.append((len(changes), tree.total(), redone))
            found = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], columns)

    edits = edits.where(F.size("edits") > 0).select(F.col("doc_id").alias("e_id"), F.col("version").alias("e_version"), "edits")
    versions = cut(edits.select(F.col("e_version").alias("version")).distinct())
    texts = keep_ids(_versioned(docs, id_col, text_col), "version", versions).dropDuplicates(["doc_id", "version"])
    old = keep_ids(trees.select("doc_id", "version", "sizes", "sums"), "version", versions).dropDuplicates(["doc_id", "version"])
    old = old.select(F.col("doc_id").alias("t_id"), F.col("version").alias("t_version"), "sizes", "sums")
    same = lambda k: F.col("doc_id").eqNullSafe(F.col(f"{k}_id")) & (F.col("version") == F.col(f"{k}_version"))
    hit = texts.join(edits, same("e")).join(old, same("t")).select("doc_id", "version", "text", "edits", "sizes", "sums")
    done = small_batches(hit).mapInArrow(run, ", ".join(f"{c} long" for c in columns)).withColumnsRenamed({"doc_id": "e_id", "version": "e_version"})
    found = trees.select("doc_id", "version", "n_tokens", "n_pretokens").join(done, same("e"), "left")
    none = F.lit(0).cast("long")
    return found.select("doc_id", F.coalesce("n_edits", none).alias("n_edits"), F.col("n_tokens").alias("n_before"), F.coalesce("n_after", "n_tokens").alias("n_after"), "n_pretokens", F.coalesce("n_redone", none).alias("n_redone"))


#: What is redacted, and what every text that holds any of it also holds.
_PERSONAL = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b\d{3}[-. ]\d{3,4}[-. ]\d{4}\b|[ \t]{2,}")
_HINT = r"(?U)@|\d{3}[-. ]\d{3}|[ \t]{2}"


def personal(text: str) -> Edits:
    """Edits that replace mail addresses and telephone numbers by a mark and runs of blanks by one blank."""
    return [(m.start(), m.end(), " " if m.group().isspace() else "[redacted]") for m in _PERSONAL.finditer(text)]


def redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of edits (``doc_id``, ``version``, ``edits``) of texts that ``personal`` changes; each text once for an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            made = [[dict(zip(("start", "end", "new"), e, strict=True)) for e in personal(t)] for t in _decoded(batch, 2)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, kind)], ["doc_id", "version", "edits"])

    rows = _versioned(docs, id_col, text_col).where(F.col("text").cast("string").rlike(_HINT))
    found = small_batches(rows).mapInArrow(run, f"doc_id long, version long, edits {_EDITS}")
    return found.where(F.size("edits") > 0).dropDuplicates(["doc_id", "version"])
