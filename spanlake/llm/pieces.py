"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut before each run of spaces that follows another character (no piece spans such a place), distinct words
are encoded together over flat symbol arrays, and each round merges, in every word, the leftmost occurrences of that
word's pair of least rank. The library pops one pair at a time from a queue ordered by score and then by position; a
merge that makes a pair of lower rank than its own would be overtaken there, so a word in which that happens merges its
leftmost occurrence alone in that round. Both orders then give the same pieces. A long word is first cut wherever its two
characters stand side by side in no piece; what is still long then has a queue of its own instead of rounds.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import slices, small_batches

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = np.int32(2**31 - 1)
#: Bytes of text encoded at once, and words kept between batches: both bound a worker's memory.
CHUNK, KEPT = 1 << 19, 150_000
#: Characters from which a word is cut, and from which a part of one is encoded by its own queue.
LONG, QUEUE = 64, 4096


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``pool[starts[i]:starts[i] + sizes[i]]`` one after another."""
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return pool[shift + np.arange(len(shift))]


class Pieces:
    """Merge table and decoding table of a BPE model with byte fallback."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        probe = "  a  b \ufb01 \u2460 \uff21\n\tx "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model normalises texts or adds no space before them")
        plain = {p: i for i, p in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        runs = {len(p): i for p, i in plain.items() if set(p) == {SPACE}}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and len(p) not in runs) for p in plain) or 1 not in runs:
            raise ValueError("the model's pieces span words; words can't be encoded apart")
        self.run_ids = np.zeros(max(runs) + 1, np.int32)
        for k, i in runs.items():
            self.run_ids[k] = i
        self.breaks = np.zeros((max(runs) + 1, max(runs) + 1), bool)  # of so many spaces, where each piece begins
        for k in range(1, max(runs) + 1):
            at = 0
            while at < k:
                self.breaks[k, at] = True
                at += max(r for r in runs if r <= k - at)
        self.bytes = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(names[i][1:-1], 16)] = i
        order = sorted((i for p, i in plain.items() if len(p) > 1 and p not in {SPACE * k for k in runs}), key=lambda i: -model.get_score(i))
        if len({model.get_score(i) for i in order}) != len(order):
            raise ValueError("pieces of equal score have no defined order")
        self.rank = np.full(n + 1, _NONE, np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        beside = {(ord(x) << 21) + ord(y) for p in plain for x, y in zip(p, p[1:])}  # noqa: B905
        self.beside = np.array(sorted(beside), np.int64)
        keys, made = [], []
        for i in order:
            p = names[i]
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    made.append(i)
        self.bits = max(10, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, n, np.int32)
        left, value = np.array(keys, np.int64), np.array(made, np.int32)
        at = self._slot(left)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]  # of several that want a slot, the last stays
            placed = self.keys[at] == left
            self.made[at[placed]] = value[placed]
            left, value, at = left[~placed], value[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
        text = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(names[i][1:-1], 16)]) if model.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.sizes = np.array([len(t) for t in text], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.pool = np.frombuffer(b"".join(text), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two symbols make, ``size`` where they make none."""
        key = left.astype(np.int64) * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -2
        out = np.full(len(key), self.size, np.int32)
        look = np.arange(len(key))
        at = self._slot(key)
        while len(look):
            there = self.keys[at]
            hit = there == key[look]
            out[look[hit]] = self.made[at[hit]]
            on = ~hit & (there >= 0)
            look, at = look[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def apart(self, word: str) -> list[str]:
        """A word cut between characters that no piece has side by side, so that no merge spans a cut."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        keys = (points[:-1] << 21) + points[1:]
        at = np.searchsorted(self.beside, keys)
        at[at == len(self.beside)] = 0
        ends = [0, *(np.flatnonzero(self.beside[at] != keys) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    @cached_property
    def _merges(self) -> dict[int, int]:
        full = self.keys >= 0
        return dict(zip(self.keys[full].tolist(), self.made[full].tolist(), strict=True))

    def _queued(self, sym: list[int]) -> list[int]:
        """What merging one pair at a time leaves of one word: the least rank first, then the leftmost."""
        rank, merges, n = self.rank, self._merges, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and sym[i] < self.size and sym[j] < self.size and (piece := merges.get(sym[i] * self.size + sym[j])) is not None and rank[piece] != _NONE:
                heapq.heappush(queue, (int(rank[piece]), i, sym[i], sym[j], piece))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, left, right, piece = heapq.heappop(queue)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue
            sym[i], sym[j] = piece, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in sym if s >= 0]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char[points]
        sym = np.where(sym < 0, self.size + points.astype(np.int32), sym)  # characters that no piece has
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_sym, done_word = [], []
        large = [k for k, w in enumerate(words) if len(w) > QUEUE]
        if large:
            ends = np.cumsum([len(w) for w in words])
            for k in large:
                done_sym.append(np.array(self._queued(sym[ends[k] - len(words[k]) : ends[k]].tolist()), np.int64))
                done_word.append(np.full(len(done_sym[-1]), k))
            rest = ~np.isin(word, large)
            sym, word = sym[rest], word[rest]
        pair = np.full(len(sym), self.size, np.int32)
        if len(sym) > 1:
            pair[:-1] = self.merged(sym[:-1], sym[1:])
            pair[:-1][word[:-1] != word[1:]] = self.size
        while len(sym):
            rank = self.rank[pair]
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(head, len(sym)))
            least = np.minimum.reduceat(rank, head)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, size)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                sym, word, pair, rank = sym[~gone], word[~gone], pair[~gone], rank[~gone]
                size, least = size[~over], least[~over]
                head = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
                if not len(sym):
                    break
            low = np.repeat(least, size)
            hit = np.flatnonzero(rank == low)
            first = np.concatenate([[True], hit[1:] != hit[:-1] + 1])  # of neighbouring hits every second one is taken
            hit = hit[(hit - np.maximum.accumulate(np.where(first, hit, 0))) % 2 == 0]
            piece = pair[hit]
            last = len(sym) - 1
            before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, last)
            joined = np.concatenate([[False], hit[1:] == hit[:-1] + 2])
            left = np.where(joined, np.concatenate([[0], piece[:-1]]), sym[before])
            overtaken = (hit > 0) & (word[before] == word[hit]) & (self.rank[self.merged(left, piece)] < low[hit])
            overtaken |= (hit + 2 <= last) & (word[after] == word[hit]) & (self.rank[self.merged(piece, sym[after])] < low[hit])
            if overtaken.any():
                bad = np.unique(word[hit[overtaken]])
                alone = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
                keep = alone | ~np.isin(word[hit], bad)
                hit, piece = hit[keep], piece[keep]
            sym[hit] = piece
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            sym, word, pair = sym[stay], word[stay], pair[stay]
            at = place[hit]
            for look in (at[at + 1 < len(sym)], at[at > 0] - 1):
                pair[look] = np.where(word[look] == word[look + 1], self.merged(sym[look], sym[look + 1]), self.size)
            pair[at[at + 1 == len(sym)]] = self.size
        if not done_sym:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return self._finish(sym[order], word[order], len(words))

    def _finish(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Spaces that are left over join from the left, up to the longest run that is a piece; others become bytes."""
        space = sym == self.run_ids[1]
        linked = np.zeros(len(sym), bool)
        linked[1:] = space[1:] & space[:-1] & (word[1:] == word[:-1])
        if linked.any():
            index = np.arange(len(sym))
            since = index - np.maximum.accumulate(np.where(linked, 0, index))
            longest = len(self.run_ids) - 1
            head = np.flatnonzero(~linked)
            run = np.diff(np.append(head, len(sym)))
            whole = np.repeat(run - run % longest, run)
            begin = np.flatnonzero(np.where(since < whole, since % longest == 0, self.breaks[np.repeat(run % longest, run), np.maximum(since - whole, 0)]))
            sizes = np.diff(np.append(begin, len(sym)))
            sym = np.where(sizes > 1, self.run_ids[np.minimum(sizes, longest)], sym[begin])
            word = word[begin]
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            raw = [self.bytes[np.frombuffer(chr(c - self.size).encode("utf-8", "surrogatepass"), np.uint8)] for c in sym[odd].tolist()]
            sizes = np.ones(len(sym), np.int64)
            sizes[odd] = [len(r) for r in raw]
            out = np.repeat(sym, sizes)
            starts = np.cumsum(sizes) - sizes
            out[gather(np.arange(len(out)), starts[odd], sizes[odd])] = np.concatenate(raw)
            sym, word = out, np.repeat(word, sizes)
        return sym.astype(np.int32), np.bincount(word, minlength=n)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts one after another without the space put before each, and how many each has."""
        sizes = self.sizes[ids]
        data = gather(self.pool, self.starts[ids], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edges = ends[np.concatenate([[0], np.cumsum(counts)])]
        length = np.diff(edges)
        starts = edges[:-1][length > 0]
        lead = starts[data[starts] == 32]
        length[np.flatnonzero(length > 0)[data[starts] == 32]] -= 1
        return np.delete(data, lead), length


@lru_cache(maxsize=2)
def load(model_path: str) -> Pieces:
    return Pieces(model_path)


class Encoder:
    """Encodes texts; the ids of frequent words stay in a bounded store."""

    def __init__(self, model_path: str) -> None:
        self.pieces = load(model_path)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        words = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        for i, found in enumerate(words):
            if max(map(len, found), default=0) > LONG:
                words[i] = [part for w in found for part in (self.pieces.apart(w) if len(w) > LONG else (w,))]
        if len(self.index) > KEPT:
            self._reset()
        new = set().union(*words).difference(self.index)
        if new:
            fresh = list(new)
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
            group = np.cumsum([len(w) for w in fresh]) // CHUNK
            for lo, hi in zip(at := np.flatnonzero(np.diff(group, prepend=-1)), [*at[1:], len(fresh)], strict=True):
                ids, sizes = self.pieces.encode(fresh[lo:hi])
                self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
                self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)]
        return gather(self.pool, self.starts[at], sizes), np.diff(ends)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids`` (all pieces of the whole text), ``decoded``.

    The ids are those of the sentencepiece library without begin or end ids and without sampling; ``decoded`` is its
    ``decode(ids)``. A null or empty text has no ids and decodes to the empty text. Rows stay as they are otherwise:
    repeated and null ids are kept, other columns are left out.
    """
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches, 1, CHUNK):
            ids, counts = encoder.encode([(b or b"").decode("utf-8", "replace") for b in batch.column(1).to_pylist()])
            data, sizes = encoder.pieces.decode(ids, counts)
            rows = pa.ListArray.from_arrays(_offsets(counts), pa.array(ids))
            decoded = pa.StringArray.from_buffers(batch.num_rows, _offsets(sizes).buffers()[1], pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), rows, decoded], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")
