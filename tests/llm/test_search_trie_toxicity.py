"""Lexical search, the prefix trie and toxicity against brute force, with nulls, empty, long, tied and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import lexical, prefix_trie, registry, toxicity

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    """(item, rank, doc_id, score) by the rule, all pairs."""
    terms = [Counter(TERM.findall((t or "").translate(ASCII))) for _, t in docs]
    n = sum(1 for t in terms if t)
    length = sum(sum(t.values()) for t in terms)
    df = Counter(w for t in terms for w in t)
    out = set()
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(ASCII)))
        scores = []
        for (doc, _), t in zip(docs, terms):
            m = 25 + (75 * sum(t.values()) * n) // length if length else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * t[w]) // (1000 * t[w] + 8 * m)) for w, q in asked.items() if t[w])
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out |= {(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_lexical_search(spark, monkeypatch):
    r = random.Random(3)
    words = ["the", "Of", "naïve", "ÄPFEL", "äpfel", "x1", "日本", "zeta", "rare", "beta", "gamma"] + [f"w{i}" for i in range(60)]
    weights = [40, 30, 3, 2, 2, 3, 1, 2, 1, 5, 4] + [2] * 60
    docs = [(i, " \n-_".join(r.choices(words, weights, k=r.choice([0, 1, 3, 20, 60])))) for i in range(240)]
    docs += [(300, None), (301, ""), (302, "\x7f--"), (None, "rare rare"), (303, "rare " * 5000), (304, docs[5][1]), (5, docs[5][1]), (305, "İI ıi")]
    items = [(1, "The rare ZETA, of beta"), (2, None), (3, "unknown"), (4, "äpfel naïve 日本 the the of"), (5, " ".join(words)), (6, "İI"), (7, docs[5][1])]
    expected = ranked(docs, items, 5)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "doc_id", "1 as item_id", "'x' as rank", "2 as score").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
    for blocks, passes in ((8192, 4096), (16, 2)):
        monkeypatch.setattr(lexical, "DOCUMENTS", blocks)
        monkeypatch.setattr(lexical, "ITEMS", passes)
        got = [tuple(x) for x in lexical.rank(d, q, 5).collect()]
        assert len(got) == len(expected) and set(got) == expected
    assert lexical.rank(d.limit(0), q).count() == 0 and lexical.rank(d, q.limit(0)).count() == 0


def test_accumulators_stop(monkeypatch):
    """Once the rest can't reach the k-th best, long lists only serve the survivors."""
    lengths, found = [50] * 3000, [np.array([0] * (1 + i % 3) + [1] * (i % 100 == 0) * 20 + [2] * (i % 150 == 0) * 20) for i in range(3000)]
    block = lexical.Block(np.arange(3000), np.array(lengths), *lexical.block_of(lengths, found))
    df = np.array([3000, 30, 20])
    weights = np.array([lexical.weight(3000, int(x)) for x in df])
    impacts = lexical.impacts_of(block, 3000, 150_000)
    best = list(lexical.search(block, impacts, [(np.array([0, 1, 2]), np.array([1, 1, 1]))], weights, df, 5))
    sums = np.zeros(3000, np.int64)
    for t in range(3):
        rows = block.docs[block.starts[t] : block.starts[t + 1]]
        sums[rows] += weights[t] * impacts[block.starts[t] : block.starts[t + 1]]
    order = np.lexsort((np.arange(3000), -sums))[:5]
    assert best[0][1].tolist() == order.tolist() and best[0][2].tolist() == sums[order].tolist()
    touched = []
    real = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *p, **k: (touched.append(np.size(v)), real(a, v, *p, **k))[1])
    list(lexical.search(block, impacts, [(np.array([0, 1, 2]), np.array([1, 1, 1]))], weights, df, 5))
    assert 5 <= max(touched[1:]) <= 40  # survivors of the rare lists are looked up in the long one


def trie(convs):
    """Nodes of the trie over {conv_id: digests}, each by the rule."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (int(p[-1][32:], 16) if p else 0)
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items()}


@pytest.mark.parametrize("case", range(4))
def test_prefix_trie(spark, case):
    r = random.Random(case)
    pool = [hashlib.md5(str(i).encode()).hexdigest() + f"{r.randint(0, 50):08x}" for i in range(3)]
    convs = {c: [r.choice(pool) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 9]))] for c in r.sample(range(-500, 10**6), [1, 60, 300, 300][case])}
    if case == 3:  # a hot conversation, a chain of prefixes of it, a hot first turn
        for k, c in enumerate(list(convs)[:200]):
            convs[c] = [pool[0]] * (40 if k < 100 else k % 40) if k < 160 else [pool[1], *convs[c]]
    got = [tuple(x) for x in prefix_trie.build(spark.createDataFrame([*convs.items()], "conv_id long, turns array<string>")).collect()]
    expected = trie(convs)
    assert len(got) == len(expected) and set(got) == expected
    assert prefix_trie.build(spark.createDataFrame([], "conv_id long, turns array<string>")).count() == 0


def test_rebuilt_conversations(spark):
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["hi", "", None, "äh 😀", "long " * 3000])) for c in [0, 1, 2, 50, 99, 100, 101, 250, 205, 7] for t in range(r.choice([1, 3, 7, 12]))]
    rows += [(1, None, "system", "first"), (2, 1, "user", "tie"), (2, 1, "user", "tie"), (None, 0, "user", "nobody"), (205, None, None, None)]
    r.shuffle(rows)
    digest = lambda role, text: hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest() + f"{len(text or ''):08x}"
    original = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            original[c].append((t is not None, t or 0, digest(role, text)))
    original = {c: [x[2] for x in sorted(own)] for c, own in original.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in original}
    expected = {c: original.get(c - c % 100, [])[: h[c]] + own[h[c] :] for c, own in original.items()}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("leader", F.lit("x"))
    got = {x.conv_id: x.turns for x in prefix_trie.share_openings(prefix_trie.conversations_of(df)).collect()}
    assert got == expected
    assert {tuple(x) for x in prefix_trie.build(prefix_trie.share_openings(prefix_trie.conversations_of(df))).collect()} == trie(expected)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_levenshtein_automaton():
    r = random.Random(4)
    terms = [("idiot", False), ("abba", False), ("worthless", False), ("disgusting", False), ("ab", False), ("idi", True), ("stüpid", False), ("abb", True)]
    machine = toxicity.Automaton(terms)
    words = ["idiot", "idi0t", "iidiot", "dumm", "abbax", "abb", "wrthles", "worthlessly", "", "a" * 5000, "disgutsing", "stupid", "😀diot"]
    for _ in range(3000):
        w = list(r.choice(terms)[0])
        for _ in range(r.randint(0, 4)):
            w[r.randint(0, len(w)) : r.randint(0, len(w))] = r.choice(["", "a", "b", "i", "t", "q"])
        words.append("".join(w))
    codes, starts, ends, first = toxicity.words_of(words)
    assert [len(first) - 1, len(starts)] == [len(words), sum(1 for w in words if re.search(r"\w", w))]
    flat = ["".join(map(chr, codes[s:e])) for s, e in zip(starts, ends)]
    term, edits = machine.match(codes, starts, ends)
    for w, t, e in zip(flat, term, edits):
        fits = [(distance(w, x), -len(x), i) for i, (x, stem) in enumerate(terms) if not stem and distance(w, x) <= toxicity.edits_of(x, False)]
        fits += [(0, -len(x), i) for i, (x, stem) in enumerate(terms) if stem and w.startswith(x)]
        assert bool(fits) == (t >= 0) and (not fits or e == min(fits)[0] and (e, t) in {(d, i) for d, _, i in fits}), w


def test_toxic_contexts_and_spans():
    model = toxicity.Model([("idiot", False), ("lower", True)], [6.0, 5.0], frozenset({"idiom"}), toxicity.WEIGHTS, -2.0)
    texts = ["You are an IDIOT.", 'He said "what an idiot" and left', "the idiom, an idi0t here", None, "", "lowering", "x " * 50_000 + "idiot", 'she called him "idiot"']
    found = list(toxicity.hits_of(model, texts))
    assert [[h[:3] for h in hits] for hits in found] == [[(0, 0, 1)], [(0, 0, 2)], [(0, 1, 0)], [], [], [(1, 0, 0)], [(0, 0, 0)], [(0, 0, 2)]]
    assert texts[0][found[0][0][3] : found[0][0][4]] == "IDIOT" and texts[6][found[6][0][3] : found[6][0][4]] == "idiot"
    scores = [toxicity.score_of(model, h) for h in found]
    assert scores[0] > scores[1] and scores[3] == scores[4] < scores[1] and scores[7] == scores[1] and all(0 <= s <= 1 for s in scores)


def test_toxicity(spark):
    r = random.Random(6)
    clean = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 9))) for _ in range(500)]
    bad = ["blargwort", "zunkhead", "krodvik"]
    rows, labels = [], []
    for i in range(900):
        text, toxic = r.choices(clean, k=r.choice([5, 40, 120])), r.random() < 0.2
        if toxic:
            for _ in range(r.randint(1, 4)):
                w = r.choice(bad) if r.random() < 0.7 else "vexo" + "".join(r.choices("aeiou", k=4))
                if r.random() < 0.15 and w[0] != "v":
                    w = w[:3] + r.choice("qxy") + w[4:]
                text.insert(r.randint(0, len(text)), w)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(901, None), (902, ""), (903, rows[0][1]), (0, rows[0][1]), (None, "blargwort zunkhead")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("score", F.lit(5))
    marks = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int").withColumn("text", F.lit("y"))
    model = toxicity.fit(docs, marks)
    found = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in found) == sorted((i is None, i or 0) for i, _ in rows)
    truth = dict(labels)
    held = [(truth[x.doc_id], x.score >= 0.5) for x in found if x.held_out and x.doc_id in truth and x.doc_id]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in found if x.doc_id is not None)
    assert len(held) > 100 and sum(t == p for t, p in held) / len(held) > 0.97 and all(not p for t, p in held if not t)
    by = {x.doc_id: x.score for x in found}
    assert by[901] == by[902] and by[903] == by[0] and by[None] > 0.5
    lied = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels], "doc_id long, toxic int")
    again = {(x.doc_id, x.score) for x in toxicity.score(docs, toxicity.fit(docs, lied)).collect()}
    assert again == {(x.doc_id, x.score) for x in found}  # labels of held-out rows are not read
    assert all(x.score < 1e-9 for x in toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_queries(spark, sf_dir):
    found = registry.op13_toxicity(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == n
