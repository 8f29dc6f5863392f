"""Corpus operators against brute force and library results, with nulls, empty and repeated rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlake.llm import components, edit_counts, embed_dedup, langid, mixing, pieces, secret_scan, setsketch, topk, url_cascade, warc_revisits

WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, label string, bucket string"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s1", len(t) if t else 0, "x", "y", "z") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    words = WORD.findall((text or "").translate(ASCII))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots_of(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (3, 2), (7, 7), (None, 4), (50, 200), (51, 200), (50, 51)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(100, 141), 100), 1: 1, 2: 1, 3: 1, 50: 50, 51: 50, 200: 50}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    texts = []
    for _ in range(8):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 60, 200, 400]))]
        for _ in range(r.randint(1, 12)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "\n", "\t  "]).join(w.upper() if r.random() < 0.2 else w for w in words))
    texts += [None, "", " \n\t", "one two", "ONE  two", "one two three", "x" * 50_000, "a b c d e " * 5000, texts[0]]
    sets = [shingles(t) for t in texts]
    expected = roots_of(len(texts), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    found = {x.doc_id: x for x in setsketch.near_duplicates(docs_of(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, s in enumerate(sets):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(s), expected[i], expected[i] == i)
    assert len(set(expected)) < len(texts) - 10
    kept = setsketch.keep_one(docs_of(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(expected))


def test_near_duplicates_blocks(spark, monkeypatch):
    """Buckets that stay apart after the centres are compared in several blocks."""
    monkeypatch.setattr(setsketch, "BLOCK", 3)
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(40):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(150)] = f"n{i}{r.random()}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    expected = roots_of(len(texts), lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    found = {x.doc_id: x.component_id for x in setsketch.near_duplicates(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(40)] == expected


def test_near_duplicates_stage(spark, monkeypatch):
    """The pipeline's stage links from 0.8 on, also where buckets are compared in blocks; pairs at 0.8 share a band."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(" ".join(f"p{i}w{k}" for k in range(49)), " ".join(f"p{i}w{k}" for k in range(5 - i % 2, 54 - i % 2))) for i in range(40)]  # 45 shingles each, 40 or 41 shared
    odd = docs_of(spark, [t for p in pairs for t in p], range(10_000, 10_080)).select(docs.columns)
    docs = docs.select(*[F.col(c).cast(k) for c, k in odd.dtypes]).unionAll(odd)
    texts = {x.doc_id: x.text for x in docs.collect()}
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]

    def survivors(percent):
        return {ids[k] for k in roots_of(len(ids), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))}

    assert len(survivors(80)) <= len(survivors(85)) - 40
    for block in (2048, 3):
        monkeypatch.setattr(setsketch, "BLOCK", block)
        found = corpus_pipeline.near_duplicates(spark, docs, "")
        assert {x.doc_id for x in found.select("doc_id").collect()} == survivors(80)
    assert (1 - 0.8**setsketch.ROWS) ** setsketch.BANDS < 3e-7


def test_near_duplicates_ids(spark):
    text = "the same words again and again for ever"
    rows = setsketch.near_duplicates(docs_of(spark, [text, text, text, "others are here to be seen now", text], [None, 5, 3, 3, 5])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in rows) == [(-1, -1, True), (3, 3, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert setsketch.near_duplicates(docs_of(spark, [])).count() == 0
    assert setsketch.keep_one(docs_of(spark, [text, text, text], [None, 5, 5])).count() == 2


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64)), np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    both = np.unique(np.concatenate([a, b]))
    sketch = lambda x: setsketch.registers(x, np.array([0, len(x)]))
    assert (setsketch.merge_registers(sketch(a), sketch(b)) == sketch(both)).all()
    near = np.unique(np.concatenate([a[:2900], b[:100]]))
    size = lambda x: np.array([float(len(x))])
    assert setsketch.plausible(sketch(a), sketch(near), size(a), size(near), 0.85)[0]
    assert not setsketch.plausible(sketch(a), sketch(b), size(a), size(b), 0.85)[0]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = random.Random(2)
    names = [model.id_to_piece(i) for i in range(300, 31_000)]
    texts = ["", None, " ", "   a  ", "a" + " " * 40 + "b", "▁ ▁▁x", "日本語 漢字 ①", "\x00\r\n\t", "😀😀", "aaaa" * 200, "<s><unk><0x0A>", "connection threads"]
    texts += ["".join(r.choice("abcdethinsor ▁.,\n中é") for _ in range(r.randint(0, 150))) for _ in range(150)]
    texts += ["".join(r.choice(names).replace("▁", r.choice(["", " "])) for _ in range(40)) for _ in range(150)]
    texts.append("".join(r.choice(names).strip("▁") for _ in range(3000)))
    found = {x.doc_id: x for x in pieces.encode_decode(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        assert (found[i].ids, found[i].n_tokens, found[i].decoded) == (ids, len(ids), model.decode(ids) if ids else "")


def test_long_unbroken_pieces(spark, monkeypatch):
    """Words without spaces are cut or queued; ids stay those of the library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = random.Random(3)
    names = [model.id_to_piece(i).strip("▁") for i in range(300, 31_000)]
    texts = ["a" * 20_000, "ab" * 9000, "=-" * 6000, "".join(r.choice("acgt") for _ in range(9000)), "".join(r.choice(names) for _ in range(8000)), " " * 9000, "今天天气" * 3000, "😀" * 5000, "x▁▁" * 3000]
    for encoder, some in ((pieces.Encoder(pieces.default_model()), texts), (None, [t[:700] for t in texts])):
        if encoder is None:
            monkeypatch.setattr(pieces, "LONG", 8)
            monkeypatch.setattr(pieces, "QUEUE", 40)
            encoder = pieces.Encoder(pieces.default_model())
        ids, counts = encoder.encode(some)
        assert ids.tolist() == [i for t in some for i in model.encode(t)] and counts.tolist() == [len(model.encode(t)) for t in some]
    found = pieces.encode_decode(docs_of(spark, texts[:1] + ["b" * 10])).collect()
    assert {x.doc_id: x.decoded for x in found} == {0: texts[0], 1: "b" * 10}


def test_piece_store_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 3)
    encoder = pieces.Encoder(pieces.default_model())
    first = encoder.encode(["some words are here", "and others there"])
    for _ in range(3):
        again = encoder.encode(["some words are here", "and others there"])
        assert (first[0] == again[0]).all() and (first[1] == again[1]).all()


def test_secret_spans(spark):
    texts = [
        "password = 'abcdef' token:abc api-key=zzzzzzzz API_KEY: q1w2e3r4t5", "AKIA" + "A1" * 8 + " AKIAshort", "x" + "0af3" * 7 + "g 0123456789abcdef0123456",
        "ſecret=abcdefgh toKen=abcdefgh", None, "", "é password=tok=secret=abc", "id 550e8400-e29b-41d4-a716-446655440000", "k=Zx9Qm2Lr7Tp4Vn8Kw3Yb6Hs1Dg5Fj0Ca", "passwd" * 9000,
    ]
    found = {x.doc_id: x for x in secret_scan.scan(docs_of(spark, texts)).collect()}
    base = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in enumerate(texts):
        t = t or ""
        expected = [("assign", *m.span()) for m in base.finditer(t) if len(m[2]) >= 6]
        expected += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        expected += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        got = [(s.kind, s.start, s.end) for s in found[i].base]
        assert sorted(got) == sorted(expected) and got == sorted(got, key=lambda s: (s[1], secret_scan.BASE_KINDS.index(s[0])))
        assert {tuple(s) for s in found[i].base} <= {tuple(s) for s in found[i].spans}
    assert [s.kind for s in found[8].spans] == ["entropy_base64"]
    assert not found[7].spans
    out = {x.doc_id: x.text for x in secret_scan.redact(docs_of(spark, texts)).collect()}
    assert out[8] == "k=[secret]" and out[4] is None and out[5] == ""


def _spans(texts, **options):
    return [[tuple(x) for x in f[1]] for f in secret_scan.find_secrets(texts, **options)]


def test_secrets_beside_allowed_strings():
    """What an allow pattern matches is passed over, and nothing else of the run it stands in."""
    key = "q7Zx81LmP0vTr4Wn9KsYb2HdEa6UcGf3"
    for text in (f"https://host.net/example/keys/{key}", f"see sample-{key}", f"{key}/dummy", f"x0123456789_{key}", f"example{key}", f"a/{key[:25]}/placeholder/{key}"):
        found = _spans([text])[0]
        at = text.rindex(key)
        assert any(k == "entropy_base64" and s <= at and e >= at + len(key) for s, e, k in found), text
    clean = ["/usr/local/share/applications/documentation", "--example/placeholder--dummy_sample/changeme", "550e8400-e29b-41d4-a716-446655440000", "1234567890-1234567890/12345", "thanbleshaningtionnt"]
    assert _spans(clean) == [[] for _ in clean]


def test_entropy_spans_by_brute_force():
    """The method's spans from each window's own counts: maximal runs, classes, allow-list, unions of windows."""
    r = random.Random(8)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "abcd", "aaaaab"]
    texts = []
    for _ in range(60):
        parts = ["".join(r.choice(r.choice(alphabets)) for _ in range(r.choice([5, 19, 20, 21, 40, 90]))) for _ in range(4)]
        parts += ["".join(r.choice(alphabets[r.randrange(3)]) for _ in range(r.choice([20, 30, 700]))), "EXAMPLE" + "".join(r.choice(alphabets[2]) for _ in range(30))]
        r.shuffle(parts)
        texts.append(r.choice([" ", ". ", "\n"]).join(parts))
    allowed = [re.compile(x) for x in secret_scan.ALLOWED]
    for text, found in zip(texts, secret_scan.entropy_spans(texts, allowed), strict=True):
        expected = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text):
            run = m.group()
            open_ = {i for i, c in enumerate(run) if c not in "+/_=-"}
            for start, part in [(0, run), *((p.start(), p.group()) for p in re.finditer("[^+/_=-]+", run))]:
                for pattern in allowed:
                    for p in pattern.finditer(part):
                        open_ -= set(range(start + p.start(), start + p.end()))
            spans = []
            for i in range(len(run) - 19):
                window = run[i : i + 20]
                bound, kind = next((b, k) for b, k, chars in ((3.0, "entropy_hex", "[0-9a-fA-F]+"), (3.4, "entropy_base32", "[A-Z0-9=]+"), (3.9, "entropy_base64", ".+")) if re.fullmatch(chars, window))
                h = -sum(window.count(c) / 20 * math.log2(window.count(c) / 20) for c in set(window))
                if h >= bound - 1e-9 and open_ & set(range(i, i + 20)):
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + 20
                    else:
                        spans.append([i, i + 20, []])
                    spans[-1][2].append(kind)
            for a, b, kinds in spans:
                expected.append((m.start() + a, m.start() + b, max(("entropy_hex", "entropy_base32", "entropy_base64"), key=kinds.count)))
        assert sorted(found) == sorted(expected)


def test_keys_leave_the_text_whole(spark):
    """Hex, base32 and base62 keys, bare, in paths and beside words: no four characters of one that is found stay, other words do."""
    r = random.Random(12)
    alphabets = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
    forms = ["%s", "see https://host.net/keys/live-%s now", "my-key-%s", "id_%s_end", "word %s, word"]
    rows = [(form, "".join(r.choice(alphabets[kind]) for _ in range(n))) for form in forms for kind in alphabets for n in (32, 40) for _ in range(25)]
    found = {x.doc_id: x.text for x in secret_scan.redact(docs_of(spark, [form % key for form, key in rows])).collect()}
    missed = 0
    for i, (form, key) in enumerate(rows):
        before, after = form.split("%s")
        if found[i] == form % key:
            missed += 1
        else:
            assert not any(key[k : k + 4] in found[i] for k in range(len(key) - 3)), (form, key, found[i])
            if " " in form:  # other words stay; those of the same run within a window of the key may go
                assert found[i].startswith(before.split("/")[0]) and found[i].endswith(after)
    assert missed <= len(rows) // 50
    split = "aB3dE5gH7-kL9nP1rS3_uV5xZ7bC9dF1-Qw2"
    assert secret_scan.redact(docs_of(spark, [f"a {split} b"])).first().text == "a [secret] b"


def test_long_candidates_and_odd_bytes(spark, monkeypatch):
    r = random.Random(9)
    run = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20_000))
    found = _spans([f"data:{run};", run[:300], run[5000:5257]])
    assert sum(e - s for s, e, _ in found[0]) > 19_000
    monkeypatch.setattr(secret_scan, "STRETCH", 1 << 20)
    assert _spans([f"data:{run};", run[:300], run[5000:5257]]) == found
    docs = docs_of(spark, ["q7Zx81LmP0vTr4Wn9KsYb2HdEa6UcGf3", "ok", None]).withColumn("text", F.when(F.col("doc_id") == 1, F.unhex(F.lit("ff2070617373776f72643d61626364656667")).cast("string")).otherwise(F.col("text")))
    assert {x.doc_id: x.text for x in secret_scan.redact(docs).collect()} == {0: "[secret]", 1: "\ufffd [secret]", 2: None}
    assert {x.doc_id: len(x.base) for x in secret_scan.scan(docs).collect()}[1] == 1
    assert setsketch.near_duplicates(docs).where("kept").count() == 3


def test_secrets_of_few_digits_and_short_ones():
    """Entropy and the allow-list alone decide, from the window's width on."""
    one, none, short = "qZxULmPavTrcWnEKsYbD7HdJeaUc", "qZxULmPavTrcWnEKsYbDkHdJeaUc", "q7Zx81LmP0vTr4Wn9KsY"
    assert [[(s, e) for s, e, _ in f] for f in _spans([one, short, none])] == [[(0, 28)], [(0, 20)], []]
    assert _spans([none], allow=()) == [[(0, 28, "entropy_base64")]]
    assert _spans([short[:19]]) == [[]]


def test_entropies_are_those_of_windows():
    r = random.Random(4)
    strings = ["".join(r.choice("abc123XYZ") for _ in range(n)) for n in (20, 24, 57, 21)]
    for s, found in zip(strings, secret_scan.entropies(strings, 20), strict=True):
        windows = [s[i : i + 20] for i in range(len(s) - 19)]
        assert np.allclose(found, [-sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) for w in windows])


VECTORS = "vec_id long, embedding array<double>, label int, part int, cell int, h1 int"


@pytest.mark.parametrize(("cell", "block"), [(2048, 2048), (20, 7)])
def test_embedding_links(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    r = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        base = r.normal(size=8)
        rows += [(base + r.normal(size=8) * s).tolist() for s in r.choice([0, 0.05, 0.15, 0.3], 10)]
    labels = r.integers(0, 2, len(rows)).tolist()
    vectors = [*rows, [0.0] * 8, None, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf")] * 8, rows[0], rows[0], [1.0, 2.0], []]
    labels += [0, 0, 0, 0, 0, labels[0], None, 0, 0]
    df = spark.createDataFrame([(i, v, k, 1, 2, 3) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))], VECTORS)
    found = {x.vec_id: x for x in embed_dedup.near_duplicates(df).collect()}
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and k is not None for v, k in zip(vectors, labels, strict=True)]

    def linked(i, j):
        if not (ok[i] and ok[j]) or labels[i] != labels[j] or len(vectors[i]) != len(vectors[j]):
            return False
        a, b = np.array(vectors[i]), np.array(vectors[j])
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93 - 1e-12

    expected = roots_of(len(vectors), linked)
    for i in range(len(vectors)):
        n = sum(linked(i, j) for j in range(len(vectors)) if j != i)
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (n, expected[i], expected[i] == i)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = np.random.default_rng(8)
    vectors = [r.normal(size=40).round(1).tolist() for _ in range(170)] + [None, [None] * 40, [float("nan")] * 40, [float("inf")] * 40]
    vectors[40] = vectors[60]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in enumerate(vectors)], VECTORS)
    got = {}
    for x in topk.top_k(df, k=7, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    q = np.floor(64 * np.array(vectors[:170])).astype(int)
    for i in range(0, 170, 20):
        scores = q @ q[i]
        best = sorted((j for j in range(170) if j != i), key=lambda j: (-scores[j], j))[:7]
        assert got.pop(i) == [(k + 1, j, scores[j]) for k, j in enumerate(best)]
    assert not got and topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.limit(3), k=20, every=1).count() == 6


def test_url_filter(spark):
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    urls = [
        "http://A.Example.NET/en/1?x", "https://example.net/de/", "http://net", "http://net?/", "x://net/", "http://b.example.com/de/#f", "http://example.com/de", "http://notexample.com/de/",
        "ftp://q.org/fr/x", None, "", "no scheme/de/", "http:///fr/", "http://ads.q.org/en/", "http://x.net/a://b", "http://ads.example.net/en/2",
    ]
    df = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("ads.q.org",), ("ads.example.net",), ("ads.unseen.org",), ("ads.q.org",), (None,)], "key string")
    found = {x.page_id: x for x in url_cascade.filter_urls(df, rules, listed).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match("([^/?#]*)([^?#]*)", rest, re.DOTALL).groups()
        host = host.translate(ASCII)
        fit = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit) if fit else (0, None, "block" if re.search(r"(^|\.)ads\.", host) else "allow")
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == (host, path, rule, verdict)
    assert url_cascade.filter_urls(df.limit(0), rules, listed).count() == 0
    assert {x.verdict for x in url_cascade.filter_urls(df.where("url like '%q.org%'"), [], listed.limit(0)).collect()} == {"allow"}


def test_url_filter_beyond_a_constant(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://ads.h{i}.org/fr/" if i % 3 else f"http://h{i}.com/", "a", "b") for i in range(100)], "page_id long, url string, host string, rule string")
    listed = url_cascade.hosts_of(df).where("key like 'ads.%'")
    rules = [("allow", "h1.org", "/fr/"), *(("block", f"h{i}.com", "/") for i in range(0, 60, 3))]
    found = url_cascade.filter_urls(df, rules, listed)
    expected = {(x.page_id, x.rule, x.verdict) for x in found.collect()}
    assert sum(v == "block" for *_, v in expected) == 65 + 20
    monkeypatch.setattr(url_cascade, "MOST_WORDS", 3)  # several shards
    again = url_cascade.filter_urls(df, rules, listed)
    assert {(x.page_id, x.rule, x.verdict) for x in again.collect()} == expected
    assert "Python" not in again._jdf.queryExecution().toString() and "BroadcastHashJoin" not in again._jdf.queryExecution().toString()
    monkeypatch.setattr(url_cascade, "AT_ONCE", 2)  # and more than a plan holds
    again = url_cascade.filter_urls(df, rules, listed)
    assert {(x.page_id, x.rule, x.verdict) for x in again.collect()} == expected


@pytest.mark.parametrize("words", [1 << 17, 8])
def test_cascade_is_exact(spark, monkeypatch, words):
    monkeypatch.setattr(url_cascade, "BITS", 2)
    monkeypatch.setattr(url_cascade, "MOST_WORDS", words)
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("listed"))
    cascade = url_cascade.Cascade.build(keys)
    assert len(cascade.shards) == (1 if words > 8 else 3) and max(map(len, cascade.shards)) > 3
    assert keys.where(cascade.listed(F.col("key")) != F.col("listed")).count() == 0


RECORDS = "record_id string, kind string, uri string, ts long, etag string, last_modified string, headers map<string,string>, payload_digest string, slice string"


def test_revisits(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        kind = r.choice(["response", "revisit"])
        host = r.choice(["a.org/x", "www.a.org/x/", "A.org:443/x?utm_source=q#f", "b.org/?p=1&ref=2"])
        headers = r.choice([None, {"etag": "1", "server": "s"}, {"date": "d", "content-length": "9"}])
        rows.append((f"{i:04}", kind, r.choice(["http://", "https://"]) + host, r.choice([None, *range(40)] * 3), r.choice([None, '"1"', 'W/"1"', '"2"']), r.choice([None, "m"]), headers, f"d{i}", "s"))
    rows += [("x", "revisit", None, 3, None, None, None, None, "s"), ("y", "other", "http://a.org/x", 3, None, None, None, None, "s")]
    canonical = {"a.org/x": "a.org/x", "www.a.org/x/": "a.org/x", "A.org:443/x?utm_source=q#f": "a.org/x", "b.org/?p=1&ref=2": "b.org?p=1"}
    found = {x.record_id: x for x in warc_revisits.resolve_revisits(spark.createDataFrame(rows, RECORDS), slices=5).collect()}
    assert set(found) == {x[0] for x in rows if x[1] == "revisit"}
    url = lambda x: x and canonical[x.split("://")[1]]
    for x in rows:
        if x[1] != "revisit":
            continue
        earlier = [y for y in rows if y[1] == "response" and x[3] is not None and x[2] and y[3] is not None and url(y[2]) == url(x[2]) and y[3] < x[3]]
        best = max(earlier, key=lambda y: (y[3], y[0]), default=None)
        got = found[x[0]]
        assert got.canonical == url(x[2]) and got.response_id == (best and best[0])
        if best is None:
            assert got.status == "no_response" and got.headers is None
            continue
        same = None
        if x[4] and best[4]:
            same = x[4].removeprefix("W/") == best[4].removeprefix("W/")
        elif x[5] and best[5]:
            same = x[5] == best[5]
        assert got.status == {None: "unverified", True: "resolved", False: "mismatch"}[same]
        merged = {**(best[6] or {}), **{k: v for k, v in (x[6] or {}).items() if k in warc_revisits.PERMITTED}}
        assert (got.headers, got.payload_digest) == ((merged, best[7]) if same else (None, None))
    assert warc_revisits.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 30)
    r = random.Random(7)
    rows = [(i, r.choice(["", "w " * r.randint(1, 9), "one\n two"]), "en", r.choice(["a"] * 8 + ["b", "c", None]), 0, "x", "y", "z") for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    used = mixing.plan(df, max_epochs=3.0).collect()
    tokens = {i: len(t.split()) for i, t, *_ in rows}
    by = {}
    for x in used:
        assert x.tokens == tokens[x.doc_id]
        by.setdefault(x.source, {}).setdefault(x.epoch, []).append(x)
    sizes = {s: sum(tokens[i] for i, _, _, q, *_ in rows if (q or "") == s) for s in by}
    top = max(sizes.values())
    exponent = 1 - math.log(3) / math.log(top / min(sizes.values()))
    for s, epochs in by.items():
        quota = sizes[s] ** exponent * top ** (1 - exponent)
        whole = math.floor(quota / sizes[s] + 1e-9)
        for e, part in epochs.items():
            assert len({x.doc_id for x in part}) == len(part)
            if e < whole:
                assert sum(x.tokens for x in part) == sizes[s]
        taken = sum(x.tokens for e in epochs.values() for x in e)
        assert quota - 1e-3 <= taken <= quota + 9 or taken == sizes[s] * whole
    assert {x.doc_id for x in used} == {x[0] for x in rows}
    shares = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    exponent = mixing.solve_exponent(shares, entropy=1.0)
    w = np.array([900, 90, 10]) ** exponent
    w = w / w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-6
    assert mixing.plan(df.limit(0)).count() == 0
    mixed = mixing.mix(df, 3.0)
    assert mixed.columns == df.columns and mixed.count() == len(used)


def test_word_counts_and_repeated_rows(spark):
    """Tokens are runs of non-blanks; equal rows are used equally often, ties and odd columns do no harm."""
    texts = ["\nfoo", "\n\n", "\tx y\n", "", None, " a  b ", "a\r\nb"]
    assert [x.n for x in docs_of(spark, texts).select(mixing.word_count(F.col("text")).alias("n"), "doc_id").orderBy("doc_id").collect()] == [1, 0, 2, 0, 0, 2, 2]
    rows = [(i, "w " * 10, "en", "large", 0) for i in range(400)] + [(1000 + i % 20, "v " * 10, "en", "small", 0) for i in range(40)] + [(None, "u", "en", "small", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `n.chars` long").withColumn("epoch", F.lit(7)).withColumn("_k1", F.lit("x")).withColumn("row", F.lit(1))
    found = mixing.mix(df, 3.0)
    assert found.columns == df.columns
    counts = {}
    for x in found.collect():
        assert (x["epoch"], x["_k1"], x["row"]) == (7, "x", 1)
        counts[x.doc_id] = counts.get(x.doc_id, 0) + 1
    planned = {}
    for x in mixing.plan(df, 3.0).collect():
        planned[x.doc_id] = planned.get(x.doc_id, 0) + 1
    assert counts == planned and all(counts[i] == 1 for i in range(400))
    assert 1.9 * 40 <= sum(n for i, n in counts.items() if i is not None and i >= 1000)
    order = [x.doc_id for x in found.collect()]
    assert order != sorted(order, key=lambda i: -1 if i is None else i) and order == [x.doc_id for x in mixing.mix(df, 3.0).collect()]


def _trigrams(text):
    """Buckets of the byte trigrams of a text between two blanks."""
    fold = lambda b: 32 if b < 65 else b + 32 if b < 91 else b
    x = [fold(b) for b in b"  " + text.encode() + b"  "]
    return [((x[i] * 961 + x[i + 1] * 31 + x[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(x) - 2)]


def test_fusion_by_brute_force(spark):
    """Posteriors from the text model, markup, suffix and smoothed host priors, each computed again from its definition."""
    docs = [x for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(x.text) < 3000][:70]
    r = random.Random(10)
    hosts = ["a.one.org", "b.one.org", "two.de", "www.two.de", "three.fr", None, "news"]
    rows = [(x.doc_id, x.text, r.choice([x.lang, x.lang.upper(), None, "zz"]), r.choice(hosts)) for x in docs] + [(9001, "", "en", "two.de"), (9002, None, None, None), (9003, "12 34", "fr", "three.fr"), (9004, "ok", "fr", "two.de")]
    captures = {docs[0].doc_id: ("FR", "three.fr"), docs[1].doc_id: (None, "b.one.org"), docs[2].doc_id: ("de", "x.y.two.de"), 77_777: ("en", "q.org")}
    df = spark.createDataFrame([(i, i, t, d, h) for i, t, d, h in rows], "id long, number long, text string, declared string, host string")
    caps = spark.createDataFrame([(k, m, h) for k, (m, h) in captures.items()], "number long, markup string, host_ string")
    found = {x.id: x for x in langid.identify(df, captures=caps).collect()}
    languages, n = langid.LANGUAGES, len(langid.LANGUAGES)
    table = np.full((n, langid.BUCKETS), langid.ADD)
    for _, t, d, _ in rows:
        if (d or "").lower() in languages and t:
            np.add.at(table[languages.index(d.lower())], _trigrams(t), 1)
    model = np.log(table / table.sum(1, keepdims=True))
    ll, squares = {}, {}
    for i, t, _, _ in rows:
        grams = _trigrams(t or "")
        ll[i] = langid.WEIGHT * model[:, grams].sum(1) if t else np.zeros(n)
        squares[i] = (model[int(ll[i].argmax()), grams] ** 2).sum()
    size = {i: len((t or "").encode()) + 2 for i, t, _, _ in rows}
    own = [i for i, t, d, _ in rows if (d or "").lower() in languages and t]
    mean = np.mean([ll[i].max() / size[i] / langid.WEIGHT for i in own])
    sd = max(np.mean([squares[i] / size[i] for i in own]) - mean**2, 0) ** 0.5
    other = {i: langid.WEIGHT * (size[i] * (mean - langid.FAR * sd) - langid.SURE * sd * size[i] ** 0.5) for i, *_ in rows}
    seen = {}
    for i, t, d, h in rows:
        markup, host = captures.get(i, (None, None))
        seen[i] = ((markup or d or "").lower(), (host or h or "").lower())
    counted = [(*seen[i], int(ll[i].argmax())) for i, t, _, _ in rows if t and ll[i].max() >= other[i]]
    vector = lambda test: np.array([sum(1.0 for d, h, k in counted if k == j and test(d, h)) for j in range(n)])
    total = vector(lambda d, h: True)
    level = {"suffix": lambda h: h.split(".")[-1], "site": lambda h: ".".join(h.split(".")[-2:]), "host": lambda h: h}
    for i, t, _, _ in rows:
        declared, host = seen[i]
        score = ll[i].copy()
        rest = other[i] + math.log(langid.OTHER / (1 - langid.OTHER))
        if any(h == host for _, h, _ in counted):
            prior = (total + 1) / (total.sum() + n)
            for name in ("suffix", "site", "host"):
                c = vector(lambda d, h, name=name: level[name](h) == level[name](host))
                prior = (c + langid.STRENGTH * prior) / (c.sum() + langid.STRENGTH)
            suffix = np.log((vector(lambda d, h: level["suffix"](h) == level["suffix"](host)) + 1) / (total + 100))
            score += np.log(prior) + suffix
            rest += math.log(np.exp(suffix).mean())
        if any(d == declared for d, _, _ in counted):
            given = np.log((vector(lambda d, h: d == declared) + 1) / (total + 100))
            score += given
            rest += math.log(np.exp(given).mean())
        top = max(score.max(), rest)
        confidence = math.exp(score.max() - top) / (np.exp(score - top).sum() + math.exp(rest - top))
        assert found[i].language == languages[int(score.argmax())] and abs(found[i].confidence - confidence) < 1e-6, i
        assert found[i].accepted == (confidence >= langid.LEAST and any(c.isalpha() for c in t or ""))


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.identify(langid.evidence_of_documents(docs)).join(docs, F.col("id") == F.col("doc_id"))
    assert found.where("language <> lang or not accepted").count() == 0
    # held out: a quarter of the rows declare nothing
    hidden = langid.evidence_of_documents(docs.withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang"))))
    right = langid.identify(hidden).join(docs, F.col("id") == F.col("doc_id")).where("doc_id % 4 = 0")
    assert right.where("language = lang").count() >= 0.95 * right.count()
    odd = docs_of(spark, [None, "", "123 456", "the house and the garden of the man", "x" * 100_000], [None, 1, 2, 3, 4])
    assert {x.id: x.accepted for x in langid.identify(langid.evidence_of_documents(odd)).collect()}.items() >= {None: False, 1: False, 2: False, 3: True}.items()
    assert sorted(x.doc_id for x in langid.keep_identified(odd).collect()) == [3, 4]
    assert langid.identify(langid.evidence_of_documents(odd.limit(0))).count() == 0


def test_stages_keep_any_columns(spark):
    """Columns whose names clash with working ones or hold dots come through the stages unchanged."""
    text = "the house and the garden of the man and the woman in the town"
    docs = docs_of(spark, [text, text + " again", None], [1, 2, 3]).drop("rep", "label", "bucket")
    docs = docs.withColumn("_rejected", F.lit("mine")).withColumn("a.b", F.lit(5)).withColumn("place", F.lit("p")).withColumn("Epoch", F.lit(3))
    for stage in (langid.keep_identified, setsketch.keep_one, secret_scan.redact, lambda d: mixing.mix(d, 2.0)):
        out = stage(docs)
        assert out.columns == docs.columns
        for x in out.collect():
            assert (x["_rejected"], x["a.b"], x["place"], x["Epoch"]) == ("mine", 5, "p", 3)


FOREIGN = {
    "it": "Quando arrivò la sera tutti i ragazzi tornarono a casa con le loro biciclette e la nonna preparò una cena molto buona per la famiglia. Il gatto dormiva sul tetto mentre la pioggia cadeva piano sulla città vecchia e sulle sue strade strette, e nessuno parlava più del lungo viaggio verso il mare.",
    "pl": "Wieczorem wszystkie dzieci wróciły do domu na swoich rowerach, a babcia przygotowała bardzo dobrą kolację dla całej rodziny. Kot spał na dachu, podczas gdy deszcz powoli padał na stare miasto i jego wąskie ulice, i nikt już nie mówił o długiej podróży nad morze.",
    "zh": "今天天气很好，我们一起去公园散步。晚上孩子们骑着自行车回家，奶奶为全家准备了一顿丰盛的晚餐。猫在屋顶上睡觉，雨慢慢地落在古老的城市里。" * 2,
}


def test_other_languages_go(spark):
    """Texts of other languages and junk have low confidence and go; those of the four languages stay."""
    r = random.Random(12)
    texts = [*FOREIGN.values(), "".join(r.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300))]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for declared in (None, "it", "zz"):
        odd = docs_of(spark, texts, range(10_000, 10_000 + len(texts))).withColumn("lang", F.lit(declared).cast("string")).select(docs.columns)
        both = docs.select(*[F.col(c).cast(k) for c, k in odd.dtypes]).unionAll(odd)
        found = langid.identify(langid.evidence_of_documents(both)).collect()
        assert all(x.accepted == (x.id < 10_000) and (x.confidence > 0.5) == x.accepted for x in found) and len(found) == both.count()
        assert {x.doc_id for x in langid.keep_identified(both).select("doc_id").collect()} == {x.doc_id for x in docs.select("doc_id").collect()}


def test_markup_far_down(spark):
    """The html tag's language counts wherever the tag begins and however long it is."""
    pages = [
        (1, "http://a.org/en/1", f"<!-- {'licence ' * 200}--><html lang='fr'><p>"), (2, "http://a.org/en/2", f"<html {'data-x=1 ' * 200}lang=de>"),
        (3, "http://a.org/en/3", '<html lang="es">'), (4, "http://a.org/en/4", "<html><p lang='es'>"), (5, "http://a.org/en/5", None),
    ]
    found = langid.captures_of_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {x.number: x.markup for x in found} == {1: "fr", 2: "de", 3: "es", 4: None, 5: None}


def test_edit_counts(spark):
    counter = edit_counts.Counter(*edit_counts.default_vocabulary())
    full = lambda t: len(counter.encoding.encode_ordinary(t))
    r = random.Random(9)
    for _ in range(600):
        text = "".join(r.choice(" \n'srelvdt1a.é") for _ in range(r.randint(0, 400)))
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, 2 * r.randint(0, 4))))
        edits = [(a, b, r.choice(["", " ", "'s", "  ", "xyz 12", "\n"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        out, at = [], 0
        for a, b, new in edits:
            out += [text[at:a], new]
            at = b
        assert edit_counts.recount(counter, text, edits)[:2] == (full(text), full("".join([*out, text[at:]])))
    texts = ["write to a.b@c.org  or call 555-123-4567", None, "", "plain"]
    docs = docs_of(spark, [*texts, texts[0], texts[0], texts[0]], [0, 1, 2, 3, 4, 4, None])
    trees = edit_counts.written(edit_counts.build_trees(docs), "trees")
    rows = edit_counts.count_after_edits(docs, trees, edit_counts.redactions(docs)).collect()
    found = {x.doc_id: x for x in rows}
    assert sorted(x.doc_id if x.doc_id is not None else -1 for x in rows) == [-1, 0, 1, 2, 3, 4, 4]
    for k in (0, 4, None):
        assert (found[k].n_edits, found[k].n_after) == (3, full("write to [redacted] or call [redacted]"))
    assert (found[1].n_before, found[2].n_after, found[3].n_after) == (0, 0, full("plain"))
    none = docs.limit(0)
    assert edit_counts.count_after_edits(none, edit_counts.build_trees(none), edit_counts.redactions(none)).count() == 0
    with pytest.raises(ValueError):
        edit_counts.Counter(edit_counts.default_vocabulary()[0], r"\s*\n|\S+|\s")


def test_edits_encode_what_they_touch(spark):
    """Of a long text only the pre-tokens about each edit are encoded, and an insertion needs no pattern in the text."""
    text = "some words that are here again, and 12 more of them; " * 4000
    docs = docs_of(spark, [text, text + "x", None, ""])
    version = {x.doc_id: x.version for x in edit_counts.build_trees(docs).collect()}
    changes = {0: [(1000, 1004, "new"), (90_000, 90_000, " in the middle "), (len(text), len(text), "end")], 1: [(0, 5, "")], 2: [(0, 0, "all of it")], 3: [(0, 0, "x")], 9: [(0, 1, "y")]}
    rows = [(k, version.get(k, 7), [dict(zip(("start", "end", "new"), e)) for e in v]) for k, v in changes.items()] + [(1, 0, [{"start": 3, "end": 9, "new": "another version"}])]  # noqa: B905
    edits = spark.createDataFrame(rows, "doc_id long, version long, edits array<struct<start: int, end: int, new: string>>")
    found = {x.doc_id: x for x in edit_counts.count_after_edits(docs, edit_counts.build_trees(docs), edits).collect()}
    full = edit_counts.Counter(*edit_counts.default_vocabulary()).encoding.encode_ordinary
    for k, old in enumerate([text, text + "x", "", ""]):
        new, at = [], 0
        for a, b, inserted in changes[k]:
            new += [old[at:a], inserted]
            at = b
        assert (found[k].n_before, found[k].n_after) == (len(full(old)), len(full("".join([*new, old[at:]]))))
        assert found[k].n_redone <= 40 * len(changes[k]) and (k > 1 or found[k].n_pretokens > 40_000)


def test_pipeline(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    texts = {x.doc_id: x.text for x in docs.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    roots = roots_of(len(ids), lambda i, j: 100 * len(sets[ids[i]] & sets[ids[j]]) >= 80 * len(sets[ids[i]] | sets[ids[j]]))
    assert {x.doc_id for x in found} == {ids[k] for k in set(roots)}
    clean = secret_scan.redact(docs)
    after = {x.doc_id: x.text for x in clean.collect()}
    kept = {ids[k] for k in set(roots)}
    tokens, of = {i: len(re.findall(r"[^ \t\n\x0b\f\r]+", after[i])) for i in kept}, {x.doc_id: x.source for x in docs.collect()}
    sizes = {q: sum(tokens[i] for i in kept if of[i] == q) for q in {of[i] for i in kept}}
    top, low = max(sizes.values()), min(v for v in sizes.values() if v)
    exponent = max(0.0, 1 - math.log(corpus_pipeline.MAX_EPOCHS) / math.log(top / low)) if top > low else 1.0
    uses = {}
    for x in found:
        uses[x.doc_id] = uses.get(x.doc_id, 0) + 1
    for q, tokens_of in sizes.items():
        quota = tokens_of**exponent * top ** (1 - exponent)
        whole = math.floor(quota / tokens_of + 1e-9) if tokens_of else 1
        assert {uses[i] for i in kept if of[i] == q} <= {whole, whole + 1}
        taken = sum(uses[i] * tokens[i] for i in kept if of[i] == q)
        assert quota - 1 <= taken <= quota + max(tokens[i] for i in kept if of[i] == q) or taken == whole * tokens_of
    assert max(uses.values()) > 1
    for x in found:
        expected = model.encode(after[x.doc_id])
        assert x.ids == expected and x.decoded_sha256 == hashlib.sha256(model.decode(expected).encode()).hexdigest()
    odd = docs_of(spark, [None, "", "words and more words in the garden of the house", "words and more words in the garden of the house"], [None, 1, 2, 3])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.columns == odd.columns
        out.collect()
        stage(spark, odd.limit(0), "/root/testdata/sf0.001").collect()


def test_sql(spark, sf_dir):
    """The queries that SQL can express, on the smallest tables."""
    import os

    import duckdb

    from spanlake.llm import registry

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    for name, sql in registry.oracle_sql().items():
        got, expected = registry.queries()[name](spark, sf_dir).toPandas(), con.execute(sql).df()
        rows = [sorted(map(str, f[sorted(expected.columns)].itertuples(index=False, name=None))) for f in (got.astype(object).where(got.notna(), None), expected.astype(object).where(expected.notna(), None))]
        assert sorted(got.columns) == sorted(expected.columns) and rows[0] == rows[1], name
