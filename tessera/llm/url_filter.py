"""URL filters: host and path rules, then exact list membership by a cascade of Bloom filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize

#: (verdict, host, path prefix): a rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Second-level names whose hosts are on the block list.
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BITS_PER_KEY, HASHES = 8, 3
#: A level's words are held in arrays of so many (8 MiB); a level of more bits (1 GiB) is refused.
CHUNK, MOST_BITS = 1 << 20, 1 << 33


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule text, verdict); nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _slots(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(HASHES)]


class BloomCascade:
    """Exact membership in a listed set for every key of a known universe.

    Level 0 holds the listed keys; each later level holds the keys of the universe that the level before wrongly
    let through. It ends when no key is let through wrongly. Each level is one row of arrays of 64-bit words, a byte
    for each of its keys, made by Spark; probing is plain arithmetic on it, so no row of the corpus is joined.
    """

    def __init__(self, universe: DataFrame, chunk: int = CHUNK):
        """universe(key, listed): each distinct key once."""
        self.levels: list[tuple[DataFrame, int]] = []
        self.chunk = chunk
        inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
        n = inside.count()
        while n:
            level, bits = len(self.levels), max(64, -(-n * BITS_PER_KEY // 64) * 64)
            if bits > MOST_BITS:
                raise ValueError(f"{n} keys need a level of {bits} bits, more than {MOST_BITS}: divide the universe")
            self.levels.append((self._words(inside, level, bits), bits))
            inside, outside = outside.where(self._passes(F.col("key"), level)), inside
            inside = materialize(inside)
            n = inside.count()

    def _words(self, keys: DataFrame, level: int, bits: int) -> DataFrame:
        slots = keys.select(F.explode(F.array(*_slots(F.col("key"), level, bits))).alias("slot"))
        words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word")
        dense = every.join(words, "word", "left").select(F.floor(F.col("word") / self.chunk).alias("chunk"), F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
        chunks = dense.groupBy("chunk").agg(F.array_sort(F.collect_list("w")).alias("w")).select(F.struct("chunk", F.col("w.bits").alias("bits")).alias("c"))
        return materialize(chunks.agg(F.array_sort(F.collect_list("c")).alias("c")).select(F.col("c.bits").alias("bits")))

    def _passes(self, key: Column, level: int) -> Column:
        words, bits = self.levels[level]
        table = words.scalar()
        hit = F.lit(True)
        for slot in _slots(key, level, bits):
            at = F.shiftright(slot, 6)
            word = F.get(F.get(table, F.floor(at / self.chunk).cast("int")), F.pmod(at, F.lit(self.chunk)).cast("int"))
            hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))) != 0)
        return hit

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the number of levels passed in a row is odd."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self._passes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def hosts_named(pages: DataFrame, names: Iterable[str] = BLOCKED_NAMES, url_col: str = "url") -> DataFrame:
    """key: the hosts of the pages with one of the names as a label before the last, each once."""
    hosts = pages.select(host_of(F.col(url_col)).alias("key")).distinct()
    return hosts.where(F.col("key").rlike(r"(^|\.)(" + "|".join(names) + r")\.[^.]"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    Where no rule fits, a host is blocked if the cascade finds it on the list. listed(key) may hold any keys, repeated
    ones and nulls too: those that no page has play no part. A null url or one without :// has an empty host and
    path, fits no rule and is allowed, unless the empty host is listed. Repeated rows stay; an empty table or list gives
    an empty result or no blocked host; other columns are ignored.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marked = listed.select("key").where("key is not null").distinct().withColumn("listed", F.lit(True))
    universe = materialize(parts.select(F.col("host").alias("key")).distinct().join(marked, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    cascade = BloomCascade(universe)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(cascade.contains(F.col("host")), "block").otherwise("allow")).alias("verdict"))
