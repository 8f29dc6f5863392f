"""Queries of the corpus operators, one for each, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import edit_counts, embed_dedup, langid, lexical, mixing, oracles, pieces, prefix_trie, secret_scan, setsketch, topk, toxicity, url_cascade, warc_revisits
from spanlake.llm.common import read


#: Rules of the URL filter as (action, host, path), and the pattern by which its list of hosts is drawn up.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ADVERTISING = r"(^|\.)(ads?|ads-track|track|tracker|tracking|banners?)\."


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve_revisits(warc_revisits.records_of_pages(read(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return found.select("record_id", "canonical", "response_id", "status", headers.alias("headers"), "payload_digest")


def op2_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_decode(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, secret_scan.BASE_KINDS), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def op4_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, captures = langid.evidence_of_documents(read(spark, sf_dir, "documents")), langid.captures_of_pages(read(spark, sf_dir, "pages"))
    found = langid.identify(evidence, captures=captures).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "language", F.round("confidence", 4).alias("confidence"), F.col("accepted").alias("kept"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"), max_epochs=2.0)


def op7_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"))


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_cascade.filter_urls(pages, URL_RULES, url_cascade.hosts_of(pages).where(F.col("key").rlike(ADVERTISING)))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = edit_counts.written(edit_counts.build_trees(docs), "trees")
    return edit_counts.count_after_edits(docs, trees, edit_counts.written(edit_counts.redactions(docs), "edits"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(prefix_trie.share_openings(prefix_trie.conversations_of(read(spark, sf_dir, "conversations"))))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_revisits": op1_warc_revisits,
        "op2_sentencepiece_round_trip": op2_sentencepiece_round_trip,
        "op3_secret_scan": op3_secret_scan,
        "op4_embedding_near_duplicates": op4_embedding_near_duplicates,
        "op5_language_id": op5_language_id,
        "op6_temperature_mixing": op6_temperature_mixing,
        "op7_setsketch_near_duplicates": op7_setsketch_near_duplicates,
        "op8_url_cascade": op8_url_cascade,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_edit_aware_counts": op10_edit_aware_counts,
        "op11_lexical_search": op11_lexical_search,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_revisits": oracles.OP1,
        "op4_embedding_near_duplicates": oracles.OP4,
        "op7_setsketch_near_duplicates": oracles.OP7,
        "op8_url_cascade": oracles.op8(URL_RULES, ADVERTISING),
        "op9_exact_top_k": oracles.OP9,
        "op11_lexical_search": oracles.OP11,
        "op12_prefix_trie": oracles.OP12,
    }
