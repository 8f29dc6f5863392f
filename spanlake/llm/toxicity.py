"""Toxicity by a lexicon met with Levenshtein automata, and by the context that a term stands in.

Labelled texts give the lexicon: words, and stems (word beginnings), that far more toxic than other texts hold; counts
are grouped aggregates over a bounded sample of labelled rows. The lexicon is a trie. Its intersection with the
automata of all terms is walked for every word of a text: a state is the set of (trie node, edits so far) that a word's
characters may have reached, and states are numbered as they first occur, so that a step of all words of a batch is a
look-up in a table. Most words leave the automaton after a few characters.

A word that labelled clean texts use often is no misspelling of a term. Each hit is judged by the words around it: quoted or
reported, addressed to somebody, or plain. A text's score is a logistic function of the log odds of its terms, summed by
kind of hit; the weight of each kind is fitted on the labelled rows, too.

Defined results: a null or empty text has no word and scores as a text without hits; a null label counts as none, several
labels of a document as toxic if one is; without labels every text scores next to 0; repeated rows are scored each. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import cut, quoted, slices, small_batches

#: Labelled rows that the classifier is fitted on, at most; taken by a hash of the identifier.
SAMPLE = 20_000
#: Terms of the lexicon, at most; lengths of stems; texts that a term must be found in at least, as a share of the toxic ones and absolutely.
TERMS, STEMS, SHARE, LEAST = 5_000, (3, 8), 0.01, 3
#: A term's log odds must exceed this even if it is so many standard errors less.
ODDS, ERRORS = math.log(2), 2.0
#: Clean texts that hold a word from which it is taken as spelled right.
CLEAN = 2
#: Words before and after a hit that make its context.
WINDOW = 8
#: Quotation marks, words that report speech, words that address somebody.
QUOTES = frozenset('"“”„«»‹›')
REPORTS = frozenset("said says say wrote writes called quote quoted quotes sagte sagt schrieb nannte zitat dit écrit cita dijo escribió llamó cita".split())
ADDRESS = frozenset("you your yours youre u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
#: Weights that a fit starts from and is drawn to, by kind of hit: words, misspelled words, stems; each plain, addressed, quoted. How strongly.
WEIGHTS, PULL = (0.6, 0.7, 0.2, 0.4, 0.5, 0.1, 0.6, 0.7, 0.2), 2.0
PLAIN, ADDRESSED, QUOTED = range(3)


def edits_of(term: str, stem: bool) -> int:
    """Edits within which a word is a misspelling of a term: none for stems and short words, two for long ones."""
    return 0 if stem or len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The lexicon's trie met with the Levenshtein automata of its terms; states are found when they are first needed."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        self.children: list[dict[int, int]] = [{}]
        self.word, self.stem, self.most = [-1], [-1], [0]  # by node: the term that ends here, the edits that a term below allows
        for i, (term, stem) in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], edits_of(term, stem))
            for c in map(ord, term):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    for a, v in ((self.word, -1), (self.stem, -1), (self.most, 0)):
                        a.append(v)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits_of(term, stem))
            (self.stem if stem else self.word)[node] = i
        alphabet = sorted({ord(c) for t, _ in terms for c in t})
        self.classes = np.zeros(0x110000, np.int16)  # 0: a character that no term has
        self.classes[alphabet] = np.arange(1, len(alphabet) + 1)
        self.characters = [-1, *alphabet]
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        # by state: the next by class (-1: not known yet), best word and stem here as edits * len(terms) + term (-1: none)
        self.table, self.at_end, self.at_once = np.empty((64, len(alphabet) + 1), np.int32), np.empty(64, np.int64), np.empty(64, np.int64)
        self.dead, self.start = self._number({}), self._number(self._closed({0: 0}))

    def _closed(self, reached: dict[int, int]) -> dict[int, int]:
        """With the nodes that are reached by leaving out characters of a term."""
        queue = list(reached.items())
        while queue:
            node, e = queue.pop()
            if e > reached.get(node, 99):
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < reached.get(child, 99):
                    reached[child] = e + 1
                    queue.append((child, e + 1))
        return reached

    def _number(self, reached: dict[int, int]) -> int:
        key = frozenset(reached.items())
        if key not in self.numbers:
            k = self.numbers[key] = len(self.sets)
            self.sets.append(key)
            if k == len(self.table):
                self.table, self.at_end, self.at_once = (np.concatenate([a, np.empty_like(a)]) for a in (self.table, self.at_end, self.at_once))
            self.table[k] = -1
            self.at_end[k], self.at_once[k] = self._best(key, self.word), self._best(key, self.stem)
        return self.numbers[key]

    def _best(self, reached: frozenset, ends: list[int]) -> int:
        found = [(e, -len(self.terms[ends[n]][0]), ends[n]) for n, e in reached if ends[n] >= 0 and e <= edits_of(*self.terms[ends[n]])]
        return min(found)[0] * len(self.terms) + min(found)[2] if found else -1

    def _step(self, state: int, kind: int) -> int:
        c, reached = self.characters[kind], {}
        for node, e in self.sets[state]:
            if (child := self.children[node].get(c)) is not None and e < reached.get(child, 99):
                reached[child] = e
            if e + 1 <= self.most[node] and e + 1 < reached.get(node, 99):
                reached[node] = e + 1  # a character too many
            for other in self.children[node].values():
                if e + 1 <= self.most[other] and e + 1 < reached.get(other, 99):
                    reached[other] = e + 1  # another character
        return self._number(self._closed(reached))

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term, edits) of the words ``codes[starts[i]:ends[i]]``, term -1 where none fits; a term within the fewest edits is given."""
        n, none = max(len(self.terms), 1), np.iinfo(np.int64).max
        best = np.full(len(starts), none)
        live, at = np.arange(len(starts)), starts.astype(np.int64)
        state = np.full(len(starts), self.start, np.int64)
        while len(live):
            over = at == ends[live]
            for mask, ready in ((over, self.at_end[state]), (~over, self.at_once[state])):
                hit = mask & (ready >= 0)
                best[live[hit]] = np.minimum(best[live[hit]], ready[hit])
            once = over & (self.at_once[state] >= 0)
            best[live[once]] = np.minimum(best[live[once]], self.at_once[state[once]])
            go = ~over
            live, at, state = live[go], at[go], state[go]
            kind = self.classes[codes[at]]
            after = self.table[state, kind]
            for k in np.unique(state[after < 0] * len(self.characters) + kind[after < 0]):
                s, c = divmod(int(k), len(self.characters))
                to = self._step(s, c)
                self.table[s, c] = to
            after = self.table[state, kind]
            go = after != self.dead
            live, at, state = live[go], at[go] + 1, after[go].astype(np.int64)
        found = best < none
        return np.where(found, best % n, -1), np.where(found, best // n, 0)


@cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """By character: its lower case where that is one character; whether words hold it (letters, marks, digits)."""
    lower, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(ch := chr(c))[0]
        word[c] = kind in "LNM"
        if kind == "L" and len(low := ch.lower()) == 1:
            lower[c] = ord(low)
    return lower, word


def words_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters in lower case, starts, ends, first word of each text and one more) of texts laid end to end."""
    texts = [t or "" for t in texts]
    lower, word = _folding()
    codes = lower[np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word[codes], [False]]).astype(np.int8)))
    begins = np.append(0, np.cumsum([len(t) + 1 for t in texts])[:-1]) if texts else np.empty(0, np.int64)
    return codes, edges[::2], edges[1::2], np.append(np.searchsorted(edges[::2], begins), len(edges) // 2)


@dataclass
class Model:
    """What is learned: terms with their log odds, words that are no misspellings, weights of the kinds of hit, log odds without a hit."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    odds: list[float] = field(default_factory=list)
    clean: frozenset[str] = frozenset()
    weights: tuple[float, ...] = WEIGHTS
    base: float = -math.inf

    @property
    def automaton(self) -> Automaton:
        if "_automaton" not in self.__dict__:
            self.__dict__["_automaton"] = Automaton(self.terms)
        return self.__dict__["_automaton"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}


def _context(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, lo: int, hi: int) -> int:
    """Kind of the context of word ``i`` among the words ``lo`` to ``hi`` of its text."""
    a, b = max(lo, i - WINDOW), min(hi, i + WINDOW + 1)
    near = lambda x, y: "".join(map(chr, codes[x:y]))
    before, after = near(starts[a], starts[i]), near(ends[i], ends[b - 1])
    around = {near(starts[j], ends[j]) for j in range(a, b) if j != i}
    if around & ADDRESS and not around & REPORTS:
        return ADDRESSED
    if (QUOTES & set(before) and QUOTES & set(after)) or around & REPORTS:
        return QUOTED
    return ADDRESSED if "!" in after[:3] else PLAIN


def hits_of(model: Model, texts: list[str | None]) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """For each text (term, edits, context, start, end) of every word that fits a term; positions count characters."""
    codes, starts, ends, first = words_of(texts)
    term, edits = model.automaton.match(codes, starts, ends)
    begin = 0
    for k, text in enumerate(texts):
        lo, hi = first[k], first[k + 1]
        own = []
        for i in lo + np.flatnonzero(term[lo:hi] >= 0):
            if edits[i] and "".join(map(chr, codes[starts[i] : ends[i]])) in model.clean:
                continue
            own.append((int(term[i]), int(edits[i]), _context(codes, starts, ends, i, lo, hi), int(starts[i] - begin), int(ends[i] - begin)))
        yield own
        begin += len(text or "") + 1


def features_of(model: Model, hits: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """Log odds of the terms found, summed by kind of hit; a term counts once a kind, and more by the logarithm of how often."""
    often: dict[tuple[int, int], int] = {}
    for term, edits, context, *_ in hits:
        key = ((2 if model.terms[term][1] else min(edits, 1)) * 3 + context, term)
        often[key] = often.get(key, 0) + 1
    sums = np.zeros(len(WEIGHTS))
    for (kind, term), n in often.items():
        sums[kind] += model.odds[term] * (1 + math.log(n))
    return sums


def score_of(model: Model, hits: list[tuple[int, int, int, int, int]]) -> float:
    """Probability that a text with these hits is toxic."""
    z = model.base + float(np.dot(model.weights, features_of(model, hits))) if model.base > -math.inf else model.base
    return 1 / (1 + math.exp(-max(min(z, 30.0), -700.0)))


def fit_weights(features: np.ndarray, toxic: np.ndarray, base: float) -> tuple[tuple[float, ...], float]:
    """Weights, none below 0, and constant of a logistic regression by Newton's method; features that few texts have stay near the start."""
    x = np.column_stack([features, np.ones(len(features))])
    w = start = np.append(WEIGHTS, base)
    pull = np.append(np.full(len(WEIGHTS), PULL), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (toxic - p) - pull * (w - start))
        w = w + step * min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w[:-1])), float(w[-1])


def _columns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(quoted([doc_id])[0].alias("doc_id"), quoted([text])[0].cast("string").alias("text"))


def held_out(key: str = "doc_id", folds: int = 5):
    """Whether a row is kept from training: the CRC of its identifier as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and stems of each text (stems end in *), with its label."""
    for batch in slices(batches, 1):
        codes, starts, ends, first = words_of(batch.column(1).to_pylist())
        flat = "".join(map(chr, codes))
        lots = []
        for k in range(batch.num_rows):
            words = {flat[s:e] for s, e in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)}
            words = {w for w in words if len(w) <= 32}
            lots.append(list(words | {w[:n] + "*" for w in words for n in range(STEMS[0], min(STEMS[1], len(w) - 1) + 1)}))
        yield pa.record_batch({"toxic": batch.column(2), "terms": pa.array(lots, pa.list_(pa.string()))})


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of a text's five-word shingles, which near copies mostly share."""
    for batch in slices(batches, 1):
        least = []
        for text in batch.column(1).to_pylist():
            words = (text or "").split()
            hashes = np.array([hash_of(w) for w in words], np.uint64)
            rows = hashes[: max(len(words) - 4, 1)].copy()
            for j in range(1, 5):
                if len(words) >= 5:
                    rows = rows * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(words) - 4 + j]
            rows = (rows ^ (rows >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            least.append(int(rows.min().view(np.int64)) if len(rows) else 0)
        yield pa.record_batch({"doc_id": batch.column(0), "toxic": batch.column(2), "signature": pa.array(least, pa.int64())})


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def choose(rows: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, bool, float]]:
    """Terms, whether they are stems, and log odds, from (term, toxic texts, clean texts that hold it).

    A stem goes if words or longer stems of its own are found about as often; a word or stem goes if a shorter stem
    that is at least as certain stands for it.
    """
    seen: dict[str, tuple[int, float, float]] = {}
    for term, t, c in rows:
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        sure = odds - ERRORS * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t >= max(LEAST, SHARE * toxic) and sure > ODDS:
            seen[term] = (t, odds, sure)
    longer: dict[str, int] = {}
    for term, (t, _, _) in seen.items():
        body = term.removesuffix("*")
        for n in range(STEMS[0], len(body) + (not term.endswith("*"))):
            if body[:n] + "*" != term:
                longer[body[:n] + "*"] = max(longer.get(body[:n] + "*", 0), t)
    kept = {term for term, (t, _, _) in seen.items() if not term.endswith("*") or longer.get(term, 0) < 0.95 * t}
    final = []
    for term in sorted(kept, key=lambda x: (-seen[x][2], x)):
        body = term.removesuffix("*")
        shorter = (body[:n] + "*" for n in range(STEMS[0], len(body) + (not term.endswith("*"))))
        if not any(s in kept and s != term and seen[s][2] >= seen[term][2] for s in shorter):
            final.append((body, term.endswith("*"), seen[term][1]))
    return final[:TERMS]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = SAMPLE) -> Model:
    """The model from labelled rows that are not held out, ``most`` of them at most; of near copies among them one counts."""
    named = labels.select(quoted([doc_id])[0].alias("doc_id"), quoted([toxic])[0].cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    chosen = named.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = small_batches(cut(_columns(docs, doc_id, text).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    one = rows.mapInArrow(_signatures, f"doc_id {kind}, toxic int, signature long").groupBy("signature").agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id")).select("doc_id")
    rows = cut(rows.join(F.broadcast(one), "doc_id", "left_semi"))
    size = rows.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("toxic"), F.sum((F.col("toxic") <= 0).cast("long")).alias("clean")).first()
    if not size.toxic or not size.clean:
        return Model()
    counts = rows.mapInArrow(_candidates, "toxic int, terms array<string>").select("toxic", F.explode("terms").alias("term")).groupBy("term")
    counts = cut(counts.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("t"), F.sum((F.col("toxic") <= 0).cast("long")).alias("c")).where(f"t >= {max(LEAST, SHARE * size.toxic)} OR c >= {CLEAN} AND term NOT LIKE '%*'"))
    odds = F.log((F.col("t") + 0.5) / (size.toxic + 1)) - F.log((F.col("c") + 0.5) / (size.clean + 1))
    worth = counts.where(F.col("t") >= max(LEAST, SHARE * size.toxic)).where(odds - ERRORS * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)) > ODDS)
    lexicon = choose(((r.term, r.t, r.c) for r in worth.toLocalIterator()), size.toxic, size.clean)
    model = Model([(t, s) for t, s, _ in lexicon], [o for _, _, o in lexicon], frozenset(), WEIGHTS, math.log(size.toxic / size.clean))

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            near = [w for w, hits in zip(words, hits_of(model, words), strict=True) if any(h[1] for h in hits)]
            yield pa.record_batch({"term": pa.array(near, pa.string())})

    usual = counts.where(f"c >= {CLEAN} AND term NOT LIKE '%*'").where(odds < ODDS).select("term")
    model.clean = frozenset(r.term for r in usual.mapInArrow(misspelled, "term string").collect())  # near a term only

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [features_of(model, hits) for hits in hits_of(model, batch.column(1).to_pylist())]
            yield pa.record_batch({"toxic": batch.column(2), "x": pa.array(found, pa.list_(pa.float64()))})

    each = rows.mapInArrow(features, "toxic int, x array<double>").groupBy("x", F.col("toxic") > 0).count().collect()  # a bounded sample, equal rows once
    each = sorted((tuple(r.x), r[1], r["count"]) for r in each)
    n = [r[2] for r in each]
    model.weights, model.base = fit_weights(np.repeat([r[0] for r in each], n, axis=0), np.repeat([float(r[1]) for r in each], n), model.base)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, hits`` of every row; hits are spans of the whole text with their term, edits and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("context", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, 1):
            scores, found = [], []
            for hits in hits_of(model, batch.column(1).to_pylist()):
                scores.append(score_of(model, hits))
                found.append([{"term": model.terms[t][0] + "*" * model.terms[t][1], "edits": e, "context": ("plain", "addressed", "quoted")[c], "start": a, "end": b} for t, e, c, a, b in hits])
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64()), "hits": pa.array(found, spans)})

    rows = small_batches(_columns(docs, doc_id, text))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, hits array<struct<term: string, edits: int, context: string, start: bigint, end: bigint>>")
