"""URL rules by Bloom filter cascades, in DataFrame functions alone.

A cascade answers membership exactly for every key of the universe it was built over: level 1 encodes the listed keys,
level 2 the unlisted keys that level 1 lets pass, level 3 the listed keys that level 2 lets pass, and so on until no
false positive is left. A key's answer is the parity of the first level that rejects it, so no join is needed. Keys are
dealt into shards by hash, each a cascade of its own, so that a level's bits stay a constant of bounded size; with many
shards, rows are judged by a bounded number of them at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import cut

#: Bits for a key, hashes, 64-bit words that the first level of a shard should have at most, and shards in a plan at once.
BITS, HASHES, MOST_WORDS, AT_ONCE = 12, 4, 1 << 17, 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Cascade:
    """Membership that is exact for all keys of the universe; ``shards`` holds the words of each level of each shard."""

    def __init__(self, shards: list[list[list[int]]]) -> None:
        self.shards = shards

    @staticmethod
    def build(universe: DataFrame) -> Cascade:
        """From ``key`` (distinct) and ``listed`` (boolean) over the whole universe; its lineage should be cut."""
        n = universe.where("listed").count()
        shards: list[list[list[int]]] = [[] for _ in range(max(1, -(-n * BITS // (64 * MOST_WORDS))))]
        dealt = universe.withColumn("shard", _shard(F.col("key"), len(shards)))
        for lo in range(0, len(shards), AT_ONCE):
            part = dealt.where(F.col("shard").between(lo, lo + AT_ONCE - 1))
            inside, outside = part.where("listed").select("shard", "key"), part.where("not listed").select("shard", "key")
            level = 0
            while keys := {r.shard: r["count"] for r in inside.groupBy("shard").count().collect()}:  # AT_ONCE rows at most
                words = {s: -(-n * BITS // 64) for s, n in keys.items()}
                size = F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.col("shard"))
                bit = F.explode(F.array(*[_position(level, i, size, F.col("key")) for i in range(HASHES)])).alias("bit")
                found = inside.select("shard", bit).groupBy("shard", (F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
                for s, w in words.items():
                    shards[s].append([0] * w)
                for row in found.toLocalIterator():  # at most the words of this level
                    shards[row.shard][level][row.word] = row.bits
                passing = F.lit(False)
                for s in words:
                    passing = F.when(F.col("shard") == s, _passes(level, shards[s][level], F.col("key"))).otherwise(passing)
                inside, outside = cut(outside.where(passing)), inside
                level += 1
        return Cascade(shards)

    def listed(self, key: Column, lo: int = 0) -> Column:
        """Whether a key is listed, for keys of the ``AT_ONCE`` shards from ``lo`` on; false for others."""
        out = F.lit(False)
        for s in range(lo, min(lo + AT_ONCE, len(self.shards))):
            levels = self.shards[s]
            own = F.lit(len(levels) % 2 == 1)
            for level in reversed(range(len(levels))):
                own = F.when(~_passes(level, levels[level], key), F.lit(level % 2 == 1)).otherwise(own)
            out = own if len(self.shards) == 1 else F.when(_shard(key, len(self.shards)) == s, own).otherwise(out)
        return out

    def keep(self, rows: DataFrame, keys: Column, name: str) -> DataFrame:
        """``rows`` with those of its ``keys`` (an array) that are listed as ``name``."""
        for lo in range(0, len(self.shards), AT_ONCE):
            found = F.filter(keys, lambda k: self.listed(k, lo))  # noqa: B023
            rows = rows.withColumn(name, found if lo == 0 else F.concat(name, found))
            if len(self.shards) > AT_ONCE:
                rows = cut(rows)
        return rows


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int")


def _position(level: int, i: int, words: Column, key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), words.cast("long") * 64)


def _passes(level: int, filled: list[int], key: Column) -> Column:
    words = F.from_json(F.lit(json.dumps(filled)), "array<bigint>")  # folded to a constant before execution
    bits = F.array(*[_position(level, i, F.lit(len(filled)), key) for i in range(HASHES)])
    return F.forall(bits, lambda at: F.getbit(F.get(words, (at / 64).cast("int")), (at % 64).cast("int")) == 1)


def _cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """Over the keys of ``universe``, of which those that ``listed`` has too are listed (both: ``key``)."""
    both = universe.select("key", F.lit(True).alias("here"), F.lit(False).alias("listed")).unionAll(listed.select("key", F.lit(False), F.lit(True)))
    both = both.groupBy("key").agg(F.bool_or("here").alias("here"), F.bool_or("listed").alias("listed"))
    return Cascade.build(cut(both.where("here and key is not null").select("key", "listed")))


def hosts_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The different hosts of ``pages`` as ``key``."""
    return pages.select(host_of(F.col(url_col)).alias("key")).distinct()


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], blocked_hosts: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` are (action, host, path): a rule fits its host and all subdomains if the path starts with its own; the
    longest (host and path together) wins, of two with different actions the block. Where none fits, hosts that the
    table ``blocked_hosts`` (``key``) lists are blocked, others allowed. Each of the three lists is a cascade over all
    keys that occur in ``pages``; keys of a list that don't occur, nulls and repeated keys change nothing. A null url,
    or one without ``://``, has an empty host and path, no rule and the verdict of the empty host. Repeated rows are
    judged alike; other columns are left out; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    lengths = sorted({len(path) for _, _, path in rules})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    rows = rows.withColumn("keys", keys)

    known = cut(rows.select(F.explode("keys").alias("key")).distinct())
    spark = pages.sparkSession
    for action in ("block", "allow"):
        listed = spark.createDataFrame([(h + p,) for a, h, p in rules if a == action], "key string")
        rows = _cascade(known, listed).keep(rows, F.col("keys"), action)
    rows = _cascade(hosts_of(pages, url_col), blocked_hosts).keep(rows, F.array("host"), "own")
    longest = F.array_max(F.transform(F.concat("block", "allow"), lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    rows = rows.withColumn("rule", longest)
    blocked = F.when(F.col("rule").isNotNull(), F.array_contains("block", F.col("rule"))).otherwise(F.size("own") > 0)
    return rows.select("page_id", "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"))
