"""Sets that share enough elements, within one group of sets or between two: what a task of a similarity join counts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A block of larger sets has so many times the rows of one of smaller sets; places that are counted at once.
WIDE, STEP = 4, 1 << 21
#: An element in so large a share of a block's possible pairs is counted by a product of matrices, so many elements at a time.
DENSE, COLUMNS = 1 / 128, 512


def links(table: pa.Table, alone: bool, threshold: float, own: int, block: int) -> Iterator[pa.RecordBatch]:
    """``a``, ``b`` (the smaller key first), ``shared``, ``size_a``, ``size_b``, ``n_a``, ``n_b`` of the pairs whose cosine reaches ``threshold``.

    ``table`` has ``k``, ``n``, ``g`` (distinct numbers) and ``at``, the group. Pairs are within the group if it is ``alone``, else between two.
    Rows are in order of size, elements of a row in order of frequency. The smaller set of a pair looks its elements up in a
    block of larger ones. If two sets share ``need`` elements, then at least ``few`` of them lie beyond the first ``need - few`` of
    the smaller one, so only those are counted; the rest of the pairs that pass comes from bits of the ``own`` most frequent elements.
    """
    rows = _Rows(table, own)
    halves = np.searchsorted(rows.at, np.unique(rows.at), side="left").tolist() + [len(rows.at)]
    sides = list(itertools.pairwise(halves))
    room = _Room(block)
    blocks = [[_Small(rows, i, min(hi, i + block), room.stride) for i in range(lo, hi, block)] for lo, hi in sides]
    for small, large in [(0, 0)] if alone and sides else [(0, 1), (1, 0)] if len(sides) == 2 else []:
        (x0, x1), (y0, y1) = sides[small], sides[large]
        for j in range(y0, y1, WIDE * block):
            ends = min(y1, j + WIDE * block)
            held = _Large(rows, j, ends)
            # sets of at least the least share of the smallest one here, and none larger than the largest
            lo = x0 + int(np.searchsorted(rows.sizes[x0:x1], threshold * threshold * rows.sizes[j] * (1 - 1e-5)))
            hi = min(x0 + int(np.searchsorted(rows.sizes[x0:x1], rows.sizes[ends - 1], side="right")), ends if alone else x1)
            found = []
            for part in blocks[small][(lo - x0) // block : -(-(hi - x0) // block)] if hi > lo else []:
                found += _pairs(rows, part, held, room, threshold - 1e-6)
                if sum(len(x) for x, _, _ in found) > 100_000:
                    yield rows.named(found)
                    found = []
            if found:
                yield rows.named(found)


class _Rows:
    """Sets by group and size; their elements by how many sets of the task hold them, without those of one set alone."""

    def __init__(self, table: pa.Table, own: int) -> None:
        table = table.combine_chunks()
        lists = table.column("g").combine_chunks()
        sizes, at = lists.value_lengths().to_numpy().astype(np.int64), table.column("at").to_numpy()
        order = np.lexsort((sizes, at))
        self.keys, self.n = table.column("k").take(pa.array(order)), table.column("n").to_numpy()[order]
        self.sizes, self.at, self.roots = sizes[order], at[order], np.sqrt(sizes[order])
        coded = lists.flatten().dictionary_encode()
        codes, count = coded.indices.to_numpy(), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        rank, place = np.empty(len(count), np.int64), np.empty(len(order), np.int64)
        rank[np.argsort(-count, kind="stable")], place[order] = np.arange(len(count)), np.arange(len(order))
        self.width = int((count > 1).sum()) + 1
        several = count[codes] > 1
        self.entries = np.sort((np.repeat(place, sizes) * self.width + rank[codes])[several])
        row, word = np.divmod(self.entries, self.width)
        self.row, self.word = row.astype(np.int32), word.astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(self.row, minlength=len(order)))])
        self.spot = (np.arange(len(row)) - self.ends[row]).astype(np.int32)
        # the most frequent elements as bits
        lanes = -(-own // 64)
        self.own = 64 * lanes
        e = np.flatnonzero(self.word < self.own)
        self.bits, self.n_own = np.zeros((len(order), lanes), np.uint64), np.bincount(self.row[e], minlength=len(order))
        np.bitwise_or.at(self.bits, (self.row[e], self.word[e] >> 6), np.uint64(1) << (self.word[e] & 63).astype(np.uint64))

    def named(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, y, shared = (np.concatenate(c) for c in zip(*found, strict=True))
        one, two = self.keys.take(pa.array(x)), self.keys.take(pa.array(y))
        first = pc.less(one, two).to_numpy()
        a, b, first = np.where(first, x, y), np.where(first, y, x), pa.array(first)
        ends = {"a": pc.if_else(first, one, two).combine_chunks(), "b": pc.if_else(first, two, one).combine_chunks()}
        return pa.record_batch({**ends, "shared": shared.astype(np.int64), "size_a": self.sizes[a], "size_b": self.sizes[b], "n_a": self.n[a], "n_b": self.n[b]})


class _Small:
    """Elements of some rows, those that are first in their rows first."""

    def __init__(self, rows: _Rows, lo: int, hi: int, stride: int) -> None:
        self.lo, self.hi = lo, hi
        e = slice(rows.ends[lo], rows.ends[hi])
        spot = rows.spot[e]
        order = np.argsort(spot.astype(np.uint16) if len(spot) and spot.max() < 65_536 else spot, kind="stable")
        self.spot, self.word, self.base = spot[order], rows.word[e][order], (rows.row[e][order] - lo) * stride
        self.cut, self.bits, self.more = -1, rows.bits[lo:hi], np.zeros(hi - lo, np.int64)

    def aside(self, rows: _Rows, cut: int) -> None:
        """Bits of the first ``cut`` elements of each row, and how many of these have none."""
        if cut == self.cut:
            return
        n = np.diff(rows.ends[self.lo : self.hi + 1])
        limit = np.where(n > cut, rows.word[np.minimum(rows.ends[self.lo : self.hi] + cut, len(rows.word) - 1)], rows.own)
        of = np.clip(limit[:, None] - 64 * np.arange(rows.bits.shape[1]), 0, 64)
        mask = np.where(of == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(of, 63).astype(np.uint64)) - np.uint64(1))
        self.cut, self.bits = cut, rows.bits[self.lo : self.hi] & mask
        self.more = np.maximum(0, np.minimum(cut, n) - rows.n_own[self.lo : self.hi])


class _Large:
    """For each element the rows that hold it, of some rows."""

    def __init__(self, rows: _Rows, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi
        e = slice(rows.ends[lo], rows.ends[hi])
        word, row = np.divmod(np.sort(rows.word[e].astype(np.int64) * (hi - lo) + (rows.row[e] - lo)), hi - lo)
        self.count = np.bincount(word, minlength=rows.width).astype(np.int32)
        self.first = (np.cumsum(self.count) - self.count).astype(np.int32)
        self.row = row


class _Room:
    """Counters of a block of pairs, all zero between uses."""

    def __init__(self, block: int) -> None:
        self.stride, self.of = -(-WIDE * block // 8) * 8, {}
        self.size = block * self.stride

    def counters(self, most: int) -> np.ndarray:
        kind = np.uint8 if most < 256 else np.uint32
        if kind not in self.of:
            self.of[kind] = np.zeros(self.size, kind)
        return self.of[kind]


def _pairs(rows: _Rows, small: _Small, large: _Large, room: _Room, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``small`` and ``large``, the smaller set first, and what they share, if that is ``least`` times the root of their sizes."""
    need = max(1, int(np.ceil(least * np.sqrt(float(rows.sizes[small.lo]) * max(rows.sizes[small.lo], rows.sizes[large.lo])) - 1e-9)))
    few = min(need, 2 + need // 8)
    begin = int(np.searchsorted(small.spot, need - few))
    if begin == len(small.spot):
        return []
    word = small.word[begin:]
    count = large.count.take(word)
    some = np.flatnonzero(count)
    count, word, base = count[some], word[some], small.base[begin:][some]
    ends = np.cumsum(count, dtype=np.int64)
    if not len(ends):
        return []
    counters = room.counters(int(small.spot[-1]) + 1)
    nx, ny = small.hi - small.lo, large.hi - large.lo
    if ends[-1] > nx * ny:
        rest = _frequent(rows, word, base // room.stride, large, counters[: nx * room.stride].reshape(nx, -1)[:, :ny])
        count, word, base = count[rest], word[rest], base[rest]
        ends = np.cumsum(count, dtype=np.int64)
        whole = True
    else:
        whole = ends[-1] * 8 > nx * ny
    places, lo, one = np.zeros(0, np.int64), 0, counters.dtype.type(1)
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, side="right")))
        c, before = count[lo:hi], ends[lo - 1] if lo else 0
        at = np.repeat(large.first.take(word[lo:hi]) - (ends[lo:hi] - c - before), c)
        at += np.arange(len(at))
        places = large.row.take(at)
        places += np.repeat(base[lo:hi], c)
        np.add.at(counters, places, one)
        whole, lo = whole or hi < len(ends), hi
    if whole:
        enough = (counters[: nx * room.stride] >= few).view(np.uint64)
        eight = np.flatnonzero(enough)
        inner = np.flatnonzero(enough[eight].view(np.bool_))
        places = eight[inner >> 3] * 8 + (inner & 7)
        shared = counters[places].astype(np.int64)
        counters[: nx * room.stride] = 0
    else:
        used, places = places, np.unique(places[counters.take(places) >= few])
        shared = counters[places].astype(np.int64)
        counters[used] = 0
    if not len(places):
        return []
    small.aside(rows, need - few)
    x, y = np.divmod(places, room.stride)
    shared += np.bitwise_count(small.bits[x] & rows.bits[large.lo + y]).sum(axis=1, dtype=np.int64)
    more, x, y = small.more[x], x + small.lo, y + large.lo
    wanted = least * rows.roots[x] * rows.roots[y] - 1e-9
    keep = (shared + more >= wanted) & ((rows.sizes[x] < rows.sizes[y]) | ((rows.sizes[x] == rows.sizes[y]) & (x < y)))
    x, y, shared, more, wanted = x[keep], y[keep], shared[keep], more[keep], wanted[keep]
    if more.any():  # elements aside without a bit are looked up one by one
        of = np.repeat(np.arange(len(x)), more)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more) + rows.n_own[x][of]
        sought = y[of] * rows.width + rows.word[rows.ends[x][of] + nth]
        hit = rows.entries[np.minimum(np.searchsorted(rows.entries, sought), len(rows.entries) - 1)] == sought
        shared += np.bincount(of[hit], minlength=len(x))
        keep = shared >= wanted
        x, y, shared = x[keep], y[keep], shared[keep]
    return [(x, y, shared)] if len(x) else []


def _frequent(rows: _Rows, word: np.ndarray, x: np.ndarray, large: _Large, counters: np.ndarray) -> np.ndarray:
    """Adds the elements that very many pairs share to ``counters``; which entries are left."""
    nx, ny = counters.shape
    many = np.bincount(word, minlength=rows.width) * large.count.astype(np.int64) > nx * ny * DENSE
    words = np.flatnonzero(many)
    column = np.full(rows.width, -1, np.int32)
    for lo in range(0, len(words), COLUMNS):
        part = words[lo : lo + COLUMNS]
        column[part] = np.arange(len(part))
        of = np.flatnonzero(column[word] >= 0)
        a, b = np.zeros((nx, len(part)), np.float32), np.zeros((ny, len(part)), np.float32)
        a[x[of], column[word[of]]] = 1
        for i, w in enumerate(part):
            b[large.row[large.first[w] : large.first[w] + large.count[w]], i] = 1
        counters += (a @ b.T).astype(counters.dtype)
        column[part] = -1
    return np.flatnonzero(~many[word])
