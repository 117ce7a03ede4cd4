"""URL filters by a cascade of Bloom filters, in DataFrame functions alone.

Level 0 holds every listed key.  Level 1 holds the corpus's unlisted keys that level 0 wrongly accepts, level 2 the
listed keys that level 1 wrongly accepts, and so on until a level accepts nothing wrongly.  Over the keys it was built
from, which are *all* keys of the corpus, the first level that rejects a key tells exactly whether it is listed: no join
and no list of keys is needed where urls are judged.  Levels shrink with the false positive rate, and the bits of each are
gathered by words of 64, so the driver sees their fixed number of words, never a key.  A list too long for a filter of
MAX_BITS is split by the keys' hashes into shards, each with a cascade of its own over its own keys; the rows are written once by shard and
judged shard by shard.

Null urls, and those without ``://``, have the empty host and path: no rule fits them, and the empty host is listed only
if the list says so.  Null keys are kept, repeated rows give a row each, other columns are ignored.  An empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.llm import common

#: Rules of the query: (verdict, host, path).  The longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The query's list: every host of the table with one of these words between dots or hyphens.
LISTED = r"(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"
#: Bits a key at level 0, and at the others; hash functions of each.
FIRST_BITS, BITS, HASHES = 8, 6, 4
#: A filter's size in bits is bounded, as it becomes a literal of the plan.
MAX_BITS = 1 << 27


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, else null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        own = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        fits = F.when(own, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


class Level:
    """One Bloom filter: its size in bits, its seed and its bits as bytes."""

    def __init__(self, size: int, seed: int, bits: bytes) -> None:
        self.size, self.seed, self.bits = size, seed, bits

    @staticmethod
    def places(key: Column, size: int, seed: int) -> list[Column]:
        """Bits of a key: double hashing."""
        a, b = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
        return [F.pmod(F.pmod(a, F.lit(size)) + k * F.pmod(b, F.lit(size - 1)) + k, F.lit(size)) for k in range(HASHES)]

    def accepts(self, key: Column) -> Column:
        out, bits = F.lit(True), F.lit(self.bits)
        for place in self.places(key, self.size, self.seed):
            byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.bit_get(byte, (place % 8).cast("int")) == 1)
        return out

    @classmethod
    def build(cls, keys: DataFrame, number: int, seed: int, per_key: int) -> Level:
        """The filter of the column ``key``, its bits set a word at a time."""
        size = 1 << max(6, math.ceil(math.log2(max(1, number) * per_key)))
        if size > MAX_BITS:
            raise ValueError(f"a filter of {size} bits is above the bound of {MAX_BITS}")
        places = keys.select(F.explode(F.array(*cls.places(F.col("key"), size, seed))).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
        bits = np.zeros(size // 64, "<i8")
        bits[np.asarray(words.column(0))] = np.asarray(words.column(1))
        return cls(size, seed, bits.tobytes())


def cascade(universe: DataFrame, listed: DataFrame, levels: int = 40) -> list[Level]:
    """Levels that tell the ``key`` column of ``listed`` from the rest of ``universe``."""
    inside = listed.select("key").where("key IS NOT NULL").distinct()
    out = [Level.build(inside, inside.count(), 0, FIRST_BITS)]
    # the only look at the list beside the first filter: which of the universe's few accepted keys are on it
    accepted = common.materialize(universe.select("key").distinct().where(out[0].accepts(F.col("key"))), "accepted")
    outside = common.materialize(accepted.join(inside, "key", "left_anti"), "wrong")
    wrong = outside
    while n := wrong.count():
        if len(out) == levels:
            raise RuntimeError("the cascade did not settle")
        out.append(Level.build(wrong, n, len(out), BITS))
        held = (inside, outside)[len(out) % 2]  # what the new level must not accept
        for level in out:
            held = held.where(level.accepts(F.col("key")))
        wrong = held
    common.drop(accepted, outside)
    return out


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: it is rejected first at an odd level, or by none and their number is odd."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(levels[k].accepts(key), out).otherwise(F.lit(k % 2 == 1))
    return out


def judge(df: DataFrame, listed: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", hosts: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed``: the longest rule's verdict, else block for a host in ``listed``,
    which has them in its column ``key``.  ``hosts``: all distinct hosts of ``df``, if they are known already."""
    spark = df.sparkSession
    host, path = parts(F.col(f"`{url}`").cast("string"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    inside = common.materialize(listed.select("key").where("key IS NOT NULL").distinct(), "listed")
    shards = max(1, -(-inside.count() * FIRST_BITS * 2 // MAX_BITS))

    def verdicts(own: DataFrame, levels: list[Level]) -> DataFrame:
        own = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("listed", member(F.col("host"), levels))
        verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
        return own.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "listed")

    universe = hosts if hosts is not None else rows.select(F.col("host").alias("key"))
    if shards == 1:
        levels = cascade(universe, inside)
        common.drop(inside)
        return verdicts(rows, levels)
    # parsed rows are written once, by shard; each shard is read, judged with its own filters and added to the result, so a
    # plan never holds more than one shard's filters
    shard = lambda c: F.pmod(F.xxhash64(F.lit("shard"), F.col(c)), F.lit(shards)).cast("int")
    parsed = common.materialize(rows.withColumn("shard", shard("host")), "urls", "shard")
    keys = common.materialize(universe.select("key").distinct().withColumn("shard", shard("key")), "hosts", "shard")
    known = common.materialize(inside.withColumn("shard", shard("key")), "keys", "shard")

    def each():
        for k in range(shards):
            yield verdicts(parsed.where(F.col("shard") == k).drop("shard"), cascade(keys.where(F.col("shard") == k), known.where(F.col("shard") == k)))

    fields = common.schema(page_id=common.LONG, host=common.STR, path=common.STR, rule=common.STR, verdict=common.STR, listed=common.BOOL)
    out = common.materialize_parts(spark, fields, each(), "verdicts")
    common.drop(inside, parsed, keys, known)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages; the list is made of all hosts of the table, which are written once."""
    pages = common.table(spark, sf_dir, "pages")
    hosts = common.materialize(pages.select(parts(F.col("url"))[0].alias("key")).distinct(), "hosts")
    out = judge(pages, hosts.where(F.col("key").rlike(LISTED)), hosts=hosts)
    common.drop(hosts)
    return out


ORACLE = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    regexp_matches(host, '{listed}') AS listed
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
""".format(listed=LISTED)
