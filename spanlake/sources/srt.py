"""Subtitle texts: one parser and one writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.functions.times import format_ms, parse_ms

_STAMPS = r"^(\d{2}:\d{2}:\d{2}[.,]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[.,]\d{3})"


def parse(df: DataFrame, keys: list[str], text: str = "srt") -> DataFrame:
    """``keys``, ``pos`` (from 1 by start), ``seq_num``, ``start_ms``, ``end_ms``, ``text`` of every valid block.

    Blocks are divided by blank lines and need three lines, the second with two time stamps; others are skipped. A
    byte order mark and carriage returns are ignored, ``seq_num`` is null if it is no number.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), "\r", ""), "^﻿", ""))
    blocks = df.select(*keys, F.posexplode(F.split(clean, r"\n\s*\n")).alias("_at", "_block"))
    lines = F.split(F.trim("_block"), "\n")
    blocks = blocks.withColumn("_l", lines).where((F.size("_l") >= 3) & F.get("_l", F.lit(1)).rlike(_STAMPS))
    stamp = lambda i: parse_ms(F.regexp_extract(F.get("_l", F.lit(1)), _STAMPS, i))
    body = F.trim(F.array_join(F.slice("_l", 3, F.size("_l")), " "))
    rows = blocks.select(*keys, "_at", F.trim(F.get("_l", F.lit(0))).try_cast("int").alias("seq_num"), stamp(1).alias("start_ms"), stamp(2).alias("end_ms"), body.alias("text"))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("start_ms", "_at"))
    return rows.withColumn("pos", pos).select(*keys, "pos", "seq_num", "start_ms", "end_ms", "text")


def render(df: DataFrame, keys: list[str], order: str, start: str = "start_ms", end: str = "end_ms", text: str = "text") -> DataFrame:
    """One subtitle text ``srt`` per key; a medium's captions are what one file holds."""
    rows = F.array_sort(F.collect_list(F.struct(order, start, end, text)))
    block = lambda x, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat(format_ms(x[start]), F.lit(" --> "), format_ms(x[end])), x[text])
    return df.groupBy(*keys).agg(rows.alias("_r")).select(*keys, F.array_join(F.transform("_r", block), "\n\n").alias("srt"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and whole ``srt`` text of every file that matches; undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("srt")).where("srt is not null")
