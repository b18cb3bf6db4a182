"""Operator 6, URL filter: rules, then a Bloom filter cascade over the corpus's hosts, in DataFrame operations only.

The keys are every host of the pages and every parent domain of one: the complete universe that a probe can come from.
Level 1 of the cascade encodes the listed keys of the universe; level 2 the other keys that level 1 lets pass by
mistake; level 3 the listed keys that level 2 lets pass, and so on until a level makes no mistake. A key is listed
exactly if the first level that doesn't hold it is an even one (or none is, and the last is odd), so membership is
exact for every page and needs no join. Level 1 is sized by the universe, so that its mistakes, and with them all
later levels, are about as many as the listed keys, whose number is bounded by ``MAX_LISTED``: the filters that go
into the plan as constants don't grow with the corpus. A longer list is cut by a hash to cascades of that size, which
the pages' hosts and paths pass one after the other, each pass ending in a checkpoint.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is allowed; repeated
rows get one result each; an empty list or table allows all; null ids are results like any other; the html and other
columns aren't read.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, native

# The contract's rules and what they say.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

# Domains listed for blocking, with all their subdomains: each name under each suffix.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_SUFFIXES = ["example.com", "example.net", "example.org"]
LISTED = [f"{name}.{suffix}" for name in LISTED_NAMES for suffix in LISTED_SUFFIXES]
#: Keys of one cascade at most; a longer list has several, one after the other.
MAX_LISTED = 1_000_000
MAX_LEVELS = 60


def parts(url: Column) -> tuple[Column, Column]:
    """The host and path of an address."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return native.ascii_lower(host), path


def keys_of(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    joined = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host != "", joined).otherwise(F.array().cast("array<string>"))


class Level:
    """One Bloom filter: how many bits and hashes, and its words as a text of numbers."""

    def __init__(self, number: int, bits: int, hashes: int):
        self.number, self.bits, self.hashes, self.words = number, bits, hashes, ""

    def spots(self, key: Column) -> list[Column]:
        a = F.pmod(F.xxhash64(F.lit(2 * self.number), key), F.lit(self.bits))
        b = F.pmod(F.xxhash64(F.lit(2 * self.number + 1), key), F.lit(self.bits))
        return [F.pmod(a + i * b, F.lit(self.bits)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        """Sets the keys' bits by a grouped bitwise or; only words with bits come to the driver."""
        spots = keys.select(F.explode(F.array(*self.spots(F.col("key")))).alias("spot"))
        one = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(spot % 64 AS INT))")
        words = dict(spots.groupBy((F.floor(F.col("spot") / 64)).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).collect())
        self.words = ",".join(str(words.get(i, 0)) for i in range(self.bits // 64))
        return self

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")  # folded once, when the plan is optimised
        out = None
        for spot in self.spots(key):
            bit = F.getbit(F.get(words, F.floor(spot / 64).cast("int")), (spot % 64).cast("int")) == 1
            out = bit if out is None else out & bit
        return out


def cascade(universe: DataFrame, listed: DataFrame, max_listed: int = MAX_LISTED) -> list[Level]:
    """The levels for the distinct (key) rows of both; a join happens here only, never for a page."""
    inside = common.checkpointed(universe.join(listed, "key", "left_semi"))
    outside = common.checkpointed(universe.join(listed, "key", "left_anti"))
    n, others = inside.count(), outside.count()
    if n > max_listed:
        raise ValueError(f"{n} listed keys; at most {max_listed} fit into a cascade")
    levels, encode, check = [], inside, outside
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade doesn't end")
        wrong = min(0.5, n / max(1, others)) if not levels else 0.5
        hashes = max(1, math.ceil(-math.log2(wrong)))
        level = Level(len(levels), 64 * max(1, math.ceil(n * hashes * 1.45 / 64)), hashes).fill(encode)
        levels.append(level)
        mistakes = common.checkpointed(check.where(level.holds(F.col("key"))))
        encode, check, n = mistakes, encode, mistakes.count()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(levels[k].holds(key), out).otherwise(F.lit(k % 2 == 1))
    return out


def rule_for(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: dict[str, str] = RULES, max_listed: int = MAX_LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (what the cascade says of the host)."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = split.select("host").distinct()
    universe = hosts.select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()
    wanted = listed.select("key").where("key IS NOT NULL").distinct()
    n_parts = max(1, -(-wanted.count() * 11 // (10 * max_listed)))  # a tenth of room, as a hash deals unevenly
    split = split.withColumn("listed", F.lit(False))
    for k in range(n_parts):
        levels = cascade(universe, wanted.where(F.pmod(F.xxhash64("key"), F.lit(n_parts)) == k), max_listed)
        if levels:
            split = split.withColumn("listed", F.col("listed") | F.exists(keys_of(F.col("host")), partial(member, levels)))
        split = split if n_parts == 1 else common.checkpointed(split)
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    out = split.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    return out.withColumn("verdict", F.coalesce(said, F.when(F.col("listed"), "block").otherwise("allow")))


def query(spark, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), listed)


ORACLE = f"""
WITH r AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule,
    {" OR ".join(f"('.' || host) LIKE '%.{k}'" for k in LISTED)} AS listed FROM h)
SELECT page_id, host, path, rule, listed, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM v
"""
