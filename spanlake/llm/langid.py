"""Language identification by fusing Bayesian evidence.

Four kinds of evidence give a posterior over languages: the text (byte trigrams, trained on all rows that declare one
of the languages), the language declared in the markup, the suffix of the address, and the host. Host priors are
smoothed hierarchically: a host's counts are backed by those of its site (the last two labels), these by the suffix and
these by the whole table. All tables of counts are grouped aggregations; hosts meet their priors in a join. One more
hypothesis, any other language or none, competes with the languages: its text is as likely per trigram as a text at the
lower edge of the spread of the rows that the model is trained on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import cut, keep_ids, quoted, slices, small_batches, unused
from spanlake.llm.url_cascade import host_of

LANGUAGES = ("de", "en", "es", "fr")
#: Hashed trigrams, weight of a trigram (neighbours overlap), smoothing of the text model and of the priors.
BUCKETS, WEIGHT, ADD, STRENGTH = 1 << 14, 0.3, 0.5, 20.0
#: Prior of another language or junk, and the edge of its texts: standard deviations of a trigram, and of a text's mean.
OTHER, FAR, SURE = 1e-3, 1.75, 4.0
#: Posterior that a document needs to be kept.
LEAST = 0.5
CHUNK = 1 << 20


def _hashed(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each byte; A-Z count as a-z, digits and blanks as one blank."""
    fold = np.arange(256)
    fold[65:91] += 32
    fold[:65] = 32
    x = fold.astype(np.uint32)[data]
    return ((x[:-2] * np.uint32(961) + x[1:-1] * np.uint32(31) + x[2:]) * np.uint32(2654435761) >> np.uint32(18)).astype(np.int32)


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [lo, hi) with the buckets of their trigrams and where each row's begin (one more at the end)."""
    lo = size = 0
    for k in range(len(texts) + 1):
        if k == len(texts) or size >= CHUNK:
            if k > lo:
                part = [b"  " + (t or b"") for t in texts[lo:k]]
                sizes = np.array([len(p) for p in part])
                starts = np.concatenate([[0], np.cumsum(sizes)])
                found = _hashed(np.frombuffer(b"".join(part) + b"  ", np.uint8))
                found[np.repeat(starts[1:] - starts[:-1], sizes) < 3] = 0
                yield lo, k, found, starts
            lo, size = k, 0
        if k < len(texts):
            size += len(texts[k] or b"")


def _counts(languages: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in slices(batches, 1, CHUNK):
            texts = batch.column(1).to_pylist()
            label = np.array([languages.index(x) if x in languages and t else -1 for x, t in zip(batch.column(0).to_pylist(), texts, strict=True)], np.int64)
            for lo, hi, found, starts in _pieces(texts):
                of = np.repeat(label[lo:hi], np.diff(starts))
                for k in range(len(languages)):
                    total[k] += np.bincount(found[: len(of)][of == k], minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return run


def train(rows: DataFrame, languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Log likelihoods (languages by buckets) from ``declared`` and ``text`` of all rows; at most that many numbers."""
    counted = rows.select("declared", F.col("text").cast("binary").alias("text")).mapInArrow(_counts(tuple(languages)), "lang int, bucket int, n long")
    table = np.full((len(languages), BUCKETS), ADD)
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r.lang, r.bucket] += r.n
    return np.log(table / table.sum(1, keepdims=True))


def _scores(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in slices(batches, 5, CHUNK):
            out, square = np.zeros((batch.num_rows, len(table))), np.zeros(batch.num_rows)
            size = np.zeros(batch.num_rows, np.int64)
            for lo, hi, found, starts in _pieces(batch.column(batch.num_columns - 1).to_pylist()):
                size[lo:hi] = np.diff(starts) - 2
                for k in range(len(table)):
                    out[lo:hi, k] = np.add.reduceat(table[k][found], starts[:-1])
                best = np.repeat(out[lo:hi].argmax(1), np.diff(starts))
                square[lo:hi] = np.add.reduceat(table[best, found[: len(best)]] ** 2, starts[:-1])
            out[size == 0] = 0
            columns = [pa.array(list(out * WEIGHT), pa.list_(pa.float64())), pa.array(square), pa.array(size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "text_ll", "square", "size"])

    return run


def _levels(host: Column) -> dict[str, Column]:
    """Keys of the hierarchy of a host: itself, its site and its suffix; a name without dots is its own at each level."""
    labels = F.split(host, r"\.")
    return {"host": host, "site": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), "suffix": F.element_at(labels, -1)}


def identify(docs: DataFrame, languages: Sequence[str] = LANGUAGES, least: float = LEAST, captures: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``language``, ``confidence``, ``accepted``.

    ``docs`` has ``id``, ``text``, ``declared`` (any string or null) and ``host`` (string or null); with ``captures``
    (``number``, ``markup``, ``host_``) also ``number``, and a capture's values go before the row's own. The log posterior
    of a language is the sum of the text's log likelihood, the smoothed log probabilities of the declared language
    (and of having declared none) and of the host's suffix given the language, and the log of the host's prior. Counts
    use each row's most likely language by text. The posterior is over the languages and one more hypothesis, any other
    language or junk: with ``mean`` and ``sd`` of a trigram's log likelihood over the rows that declare one of the
    languages, each row counting once, its text has ``mean - sd * (FAR + SURE / sqrt(trigrams))`` for a trigram. Rows
    whose text it explains best are left out of the counts, and the declared language and the suffix say nothing about it.
    ``language`` is the best of the languages, ``accepted`` says that its posterior reaches ``least`` and that
    the text has at least one letter; a null, empty or letterless text is never accepted. Ties go to the language that
    comes first. Unknown declared languages are evidence like any other value. Repeated rows are judged alike; an empty
    table gives no rows.
    """
    languages = tuple(languages)
    n = len(languages)
    number = F.lit(None).cast("long") if captures is None else F.col("number")
    rows = docs.select("id", number.alias("number"), F.coalesce(F.lower("declared"), F.lit("")).alias("declared"), F.coalesce(F.lower("host"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    model = small_batches(rows).sparkSession.sparkContext.broadcast(train(rows, languages))  # languages * BUCKETS numbers
    scored = rows.select("id", "number", "declared", "host", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col("text").cast("binary").alias("text"))
    kind = dict(docs.select("id").dtypes)["id"]
    scored = scored.mapInArrow(_scores(model), f"id {kind}, number long, declared string, host string, letters boolean, text_ll array<double>, square double, size long")
    own = F.col("declared").isin(*languages)  # before a capture's value goes before it: the rows of the model
    scored = scored.withColumn("own", own)
    if captures is not None:  # texts have been scored before this shuffle
        scored = scored.join(captures, "number", "left").withColumn("declared", F.coalesce(F.lower("markup"), "declared")).withColumn("host", F.coalesce("host_", "host"))
    scored = cut(scored.select("id", "declared", "host", "letters", "text_ll", "square", "size", "own"))
    trigrams = F.col("size") + 2  # with those that reach into the blanks around a text
    m = scored.where("own and size > 0").agg(F.avg(F.array_max("text_ll") / trigrams / WEIGHT).alias("mean"), F.avg(F.col("square") / trigrams).alias("square")).first()
    if m["mean"] is None:  # nothing declares a language, so the text says nothing
        edge = F.lit(float("-inf"))
    else:
        sd = max(m["square"] - m["mean"] ** 2, 0.0) ** 0.5
        edge = WEIGHT * (trigrams * (m["mean"] - FAR * sd) - SURE * sd * F.sqrt(trigrams))
    scored = scored.withColumn("other_ll", edge)
    levels = _levels(F.col("host"))
    best = F.expr("array_position(text_ll, array_max(text_ll)) - 1").cast("int")
    counts = cut(scored.where("size > 0 and array_max(text_ll) >= other_ll").groupBy("declared", "host", best.alias("k")).count())
    one = lambda *by: counts.groupBy(*by).agg(*[F.sum(F.when(F.col("k") == k, F.col("count")).otherwise(0)).cast("double").alias(f"n{k}") for k in range(n)])
    whole = one().first()
    total = [float(whole[f"n{k}"] or 0) for k in range(n)]
    root = F.array(*[F.lit((t + 1) / (sum(total) + n)) for t in total])

    def smoothed(names: Sequence[str], prior: Column) -> Column:
        all_ = sum((F.col(c) for c in names[1:]), F.col(names[0]))
        return F.array(*[(F.col(c) + F.lit(STRENGTH) * F.get(prior, F.lit(i))) / (all_ + F.lit(STRENGTH)) for i, c in enumerate(names)])

    names = [f"n{k}" for k in range(n)]
    priors = counts.select(levels["suffix"].alias("suffix"), levels["site"].alias("site"), "host").distinct()
    for level, parent in (("suffix", root), ("site", F.col("p_suffix")), ("host", F.col("p_site"))):
        table = one(levels[level].alias(level))
        priors = priors.join(table, level).withColumn(f"p_{level}", smoothed(names, parent)).drop(*names)
    given = lambda key, name: one(key.alias("key")).select("key", F.array(*[F.log((F.col(f"n{k}") + 1) / F.lit(total[k] + 100)) for k in range(n)]).alias(name))
    declared = given(F.col("declared"), "declared_ll").withColumnRenamed("key", "declared")
    suffix = given(levels["suffix"], "suffix_ll").withColumnRenamed("key", "suffix")
    priors = priors.join(suffix, "suffix").select("host", F.transform("p_host", lambda p: F.log(p)).alias("host_ll"), "suffix_ll")
    none = F.array(*[F.lit(0.0)] * n)
    fused = scored.join(priors, "host", "left").join(declared, "declared", "left")
    parts = [F.col("text_ll")] + [F.coalesce(c, none) for c in ("host_ll", "suffix_ll", "declared_ll")]
    fused = fused.withColumn("ll", F.array(*[sum((F.get(p, F.lit(k)) for p in parts[1:]), F.get(parts[0], F.lit(k))) for k in range(n)]))
    mean = lambda c: F.log(F.aggregate(F.coalesce(c, none), F.lit(0.0), lambda s, x: s + F.exp(x)) / n)
    other = F.col("other_ll") + mean(F.col("suffix_ll")) + mean(F.col("declared_ll")) + F.lit(float(np.log(OTHER / (1 - OTHER))))
    fused = fused.withColumn("other", other)
    top = F.greatest(F.array_max("ll"), "other")
    confidence = F.exp(F.array_max("ll") - top) / F.aggregate("ll", F.exp(F.col("other") - top), lambda s, x: s + F.exp(x - top))
    language = F.get(F.array(*[F.lit(x) for x in languages]), F.expr("array_position(ll, array_max(ll)) - 1").cast("int"))
    return fused.select("id", language.alias("language"), confidence.alias("confidence"), (F.col("letters") & (confidence >= least)).alias("accepted"))


def evidence_of_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``id`` (the column ``key``), ``number``, ``text``, ``declared`` and ``host`` of documents; their source is the host."""
    return docs.select(
        F.col(key).alias("id"), F.col("doc_id").cast("long").alias("number"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """``number``, ``markup`` and ``host_``: a page whose address ends in a document's number is that document's capture.

    Of several captures the one with the smallest id counts. Pages without a number, or with a null address, have none.
    """
    number = F.regexp_extract(F.regexp_extract("url", r"^[^?#]*", 0), r"/(\d{1,18})(?:\.html|/)?$", 1)
    markup = F.regexp_extract("html", r"<html[^>]*\slang=[\"']?([A-Za-z]+)", 1)
    seen = pages.select(F.expr("try_cast(page_id AS BIGINT)").alias("page_id"), number.try_cast("long").alias("number"), host_of(F.col("url")).alias("host_"), F.nullif(markup, F.lit("")).alias("markup"))
    seen = seen.where("number is not null").groupBy("number").agg(F.min(F.struct("page_id", "host_", "markup")).alias("p"))
    return seen.select("number", "p.host_", "p.markup")


def keep_identified(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``docs`` (all its columns) without the rows whose language is not accepted; see ``identify``.

    Rows with a null id are judged by their text like others. Only the keys of rejected rows travel.
    """
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    evidence = evidence_of_documents(docs.select(key.alias("key"), "doc_id", "text", "lang", "source"), "key")
    found = identify(evidence, captures=None if pages is None else captures_of_pages(pages))
    name = unused("_rejected", docs.columns)
    rejected = found.where("not accepted").select(F.to_json("id").alias(name)).distinct()
    return keep_ids(docs.withColumn(name, F.to_json(key)), name, cut(rejected), "left_anti").select(quoted(docs.columns))
