"""Ranked lexical search: term-at-a-time over an inverted index in blocks of documents, with limited accumulators.

The terms of a group of items are looked for in all documents. Each task turns its documents into blocks, an inverted
list a term, which are written to the shared folder; sums over the blocks give the statistics of the whole collection.
Then each block is searched on its own, one item after another: lists are taken rarest term first, and each document
met gets an accumulator. Once the bounds of the remaining lists together can't reach the block's k-th best partial score
no accumulator is created any more; those that may still reach it are carried on exactly, by looking them up in the
remaining, longer lists. The k best of every block are merged.

Defined results: a null text has no term; an item or a document without terms ranks nothing; a document without id
counts in the statistics and isn't ranked; repeated rows are ranked each; each row of the items is an item; no documents
or no items give an empty table. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import quoted, slices, small_batches
from spanlake.storage import shared_folder

#: Documents and occurrences of a block, and items that are searched in one pass: all bound what a task or the driver holds.
DOCUMENTS, OCCURRENCES, ITEMS = 8192, 1 << 21, 4096
#: Bytes that belong to no term become spaces, A-Z become a-z; bytes from 0x80 on are parts of other characters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: maximal runs of ASCII letters and digits and of all other characters."""
    return text.translate(_FOLD).split() if text else []


@dataclass
class Block:
    """Inverted lists: ``docs[starts[i]:starts[i + 1]]`` are the rows, ascending, that hold ``terms[i]``, ``tfs`` how often."""

    doc_ids: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    tfs: np.ndarray


def block_of(lengths: list[int], found: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(terms, starts, docs, tfs) for the term numbers found in each document."""
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    keys, tfs = np.unique(np.concatenate([*found, np.empty(0, np.int64)]) * max(len(lengths), 1) + rows, return_counts=True)
    terms, starts = np.unique(keys // max(len(lengths), 1), return_index=True)
    return terms, np.append(starts, len(keys)), keys % max(len(lengths), 1), tfs


_INDEX = "doc_ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, docs array<int>, tfs array<int>, n_docs long, n_terms long"


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of all documents for the terms in ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            terms, starts, rows, tfs = block_of(lengths, found)
            n = np.array(lengths)
            row = {"doc_ids": ids, "lengths": lengths, "terms": terms.astype(np.int32), "sizes": np.diff(starts).astype(np.int32), "docs": rows.astype(np.int32), "tfs": tfs.astype(np.int32)}
            kinds = {"doc_ids": pa.int64(), "lengths": pa.int64()}
            arrays = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kinds.get(k, pa.int32()))) for k, v in row.items()}
            return pa.record_batch(arrays | {"n_docs": pa.array([int((n > 0).sum())], pa.int64()), "n_terms": pa.array([int(n.sum())], pa.int64())})

        for batch in slices(batches, 1):
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = terms_of(value)
                hits = np.fromiter((i for i in map(vocabulary.get, words) if i is not None), np.int64)
                if ids and (len(ids) == DOCUMENTS or held + len(hits) > OCCURRENCES):
                    yield flush()
                    ids, lengths, found, held = [], [], [], 0
                ids.append(key)
                lengths.append(len(words))
                found.append(hits)
                held += len(hits)
        if ids:
            yield flush()

    both = docs.select(quoted([doc_id])[0].cast("long").alias("doc_id"), quoted([text])[0].cast("string").alias("text"))
    return small_batches(both).mapInArrow(run, _INDEX)


def search(block: Block, impacts: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, rarity: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the item, document ids, scores) of the ``k`` best documents of the block for each item that has any.

    An item is its terms and how often it has each; ``weights`` and ``rarity`` (documents of the collection) are by term.
    """
    if not len(block.terms):
        return
    most = np.maximum.reduceat(impacts, block.starts[:-1])
    sums = np.zeros(len(block.doc_ids), np.int64)
    for number, (terms, repeats) in enumerate(items):
        at = np.searchsorted(block.terms, terms)
        here = np.flatnonzero(block.terms[np.minimum(at, len(block.terms) - 1)] == terms)
        here = here[np.argsort(rarity[terms[here]], kind="stable")]
        lists, scale = at[here], weights[terms[here]] * repeats[here]
        rest = np.append(np.cumsum((scale * most[lists])[::-1])[::-1], 0)  # what the lists from each on can add at most
        sums[:] = 0
        survivors, floor = None, 0
        for step, (i, w) in enumerate(zip(lists, scale, strict=True)):
            rows, added = block.docs[block.starts[i] : block.starts[i + 1]], impacts[block.starts[i] : block.starts[i + 1]]
            if survivors is None:
                sums[rows] += w * added
                if rest[step + 1] < sums.max():  # else no k-th best score can exceed the rest
                    partial = sums[sums > 0]
                    if len(partial) >= k and rest[step + 1] < (floor := int(np.partition(partial, len(partial) - k)[len(partial) - k])):
                        survivors = np.flatnonzero(sums + rest[step + 1] >= max(floor, 1))
            else:
                spot = np.minimum(np.searchsorted(rows, survivors), len(rows) - 1)
                sums[survivors] += np.where(rows[spot] == survivors, w * added[spot], 0)
                partial = sums[survivors]
                floor = max(floor, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
                survivors = survivors[partial + rest[step + 1] >= floor]
        last = np.flatnonzero(sums > 0) if survivors is None else survivors[sums[survivors] > 0]
        last = last[np.lexsort((block.doc_ids[last], -sums[last]))][:k]
        if len(last):
            yield number, block.doc_ids[last], sums[last].copy()


def impacts_of(block: Block, n_docs: int, n_terms: int) -> np.ndarray:
    """What each occurrence list entry adds for a weight of one."""
    m = 25 + (75 * block.lengths * n_docs) // max(n_terms, 1)
    tf = block.tfs.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[block.docs])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _terms_of_items(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            counted = []
            for value in batch.column(1).cast(pa.binary()).to_pylist():
                own: dict[bytes, int] = {}
                for term in terms_of(value):
                    own[term] = own.get(term, 0) + 1
                counted.append(own)
            yield pa.record_batch({"item_id": batch.column(0), "terms": pa.array([list(c) for c in counted], pa.list_(pa.binary())), "repeats": pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))})

    return small_batches(items).mapInArrow(run, "item_id long, terms array<binary>, repeats array<long>")


def _one_pass(docs: DataFrame, items: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """The ``k`` best documents of every block for a bounded number of items."""
    spark = docs.sparkSession
    rows = _terms_of_items(items).collect()
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
    wanted = [r.item_id for r in rows]
    asked = [(np.array([vocabulary[bytes(t)] for t in r.terms], np.int64), np.array(r.repeats, np.int64)) for r in rows]
    folder = shared_folder(spark, "lexical")
    build_index(docs, vocabulary, doc_id, text).write.parquet(folder)
    index = spark.read.schema(_INDEX).parquet(folder)
    total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = total.docs or 0, total.terms or 0
    lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    rarity = np.zeros(len(vocabulary), np.int64)
    for r in lists.collect():  # a row for each term of the items at most
        rarity[r.terms] = r.df
    weights = np.array([weight(n_docs, int(df)) for df in rarity], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                own = {name: batch.column(name)[j].values for name in ("doc_ids", "lengths", "terms", "sizes", "docs", "tfs")}
                known = own["doc_ids"].is_valid().to_numpy(zero_copy_only=False)
                ids = own["doc_ids"].fill_null(0).to_numpy(zero_copy_only=False)
                lengths, terms, sizes, at, tfs = (own[n].to_numpy(zero_copy_only=False) for n in ("lengths", "terms", "sizes", "docs", "tfs"))
                block = Block(ids, lengths, terms, np.append(0, np.cumsum(sizes, dtype=np.int64)), at, tfs)
                impacts = np.where(known[at], impacts_of(block, n_docs, n_terms), 0)
                for number, best, scores in search(block, impacts, asked, weights, rarity, k):
                    yield pa.record_batch({"item": pa.array([number] * len(best), pa.int64()), "item_id": pa.array([wanted[number]] * len(best), pa.int64()), "doc_id": pa.array(best), "score": pa.array(scores)})

    return index.select("doc_ids", "lengths", "terms", "sizes", "docs", "tfs").mapInArrow(run, "item long, item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` documents that score highest for each item, equal scores by document id."""
    asked = items.select(quoted([item_id])[0].cast("long").alias("item_id"), quoted([item_text])[0].cast("string").alias("text"))
    passes = max(1, math.ceil(asked.count() / ITEMS))
    order = Window.partitionBy("pass", "item").orderBy(F.desc("score"), "doc_id")
    found = None
    for p in range(passes):
        own = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p)
        best = _one_pass(docs, own, k, doc_id, text).withColumn("pass", F.lit(p))
        found = best if found is None else found.union(best)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
