"""A corpus pipeline over the documents table: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import langid, mixing, pieces, secret_scan, setsketch
from spanlake.llm.common import read
from spanlake.storage import shared_folder

#: The most often that mixing uses a document on average of its source; the largest source is used once. As in op6.
MAX_EPOCHS = 2.0
#: Shared share of five-word shingles, in percent, from which documents are near-duplicates.
NEAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not accepted go."""
    return langid.keep_identified(docs, read(spark, sf_dir, "pages"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return setsketch.keep_one(docs, NEAR)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, in its order: documents of small sources are repeated towards flatter weights, each is used at least once."""
    return mixing.mix(docs, MAX_EPOCHS)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document of the mixture."""
    return pieces.encode_decode(docs).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: SQL cannot express the stages; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table."""
    folder = shared_folder(spark, "corpus")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
