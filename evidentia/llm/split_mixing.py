"""Operator 11, mixing sources to target weights by a multivariate-hypergeometric splitting tree, in words.

A source's documents stand end to end in the order of a hash of doc_id and are cut to blocks of equal numbers of words; a
permutation of block numbers, another one in each epoch, says in which order blocks are drawn. A source's target makes its exact
block quota: all blocks of the first epoch before any of the second, the last one only as far as the target goes, so the words
taken are the target rounded to a word. The tree deals the quotas to output shards: at its root are all sources' quotas, and each
node splits its vector between its two halves by a multivariate hypergeometric draw for the half's capacity. A shard so has
from each source a range of the drawing order; ranges are disjoint and cover the quota. Blocks join their shards by source and
place, and each shard is shuffled by itself.

Scale: documents get their place by sums over hash buckets, then within a bucket, so no source passes one task; block size grows
with the corpus, so that there are at most ``MAX_BLOCKS`` blocks; a task draws only the branches above its own shards, each
node's draw being seeded by its place in the tree. Reruns and lost executors give the same mix. One row a source goes to
the driver, at most ``MAX_SOURCES``; more stop with an error.

Defined results: a null text and a text without words have size 0 and nothing taken; a null source is the last source; a
source without words has target 0; rows that repeat a doc_id are documents of their own, with one place each; a null doc_id is
a document like any other; without documents there are no rows; other columns aren't read by the query and aren't kept by a mix.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# The contract's weights in the order of sources, share of all words, and the most copies of a document.
WEIGHTS, SHARE, COPIES = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_WORDS, MAX_BLOCKS, MAX_SOURCES = 256, 1 << 22, 1 << 28, 1_000_000
#: A prime beyond any number of blocks: its products permute block numbers. The second is the step from one epoch to the next.
PRIME, STEP, SEED = (1 << 61) - 1, 7919, 11
#: Documents that a hash bucket has in the mean, all sources together, and the fewest hexadecimal digits of a bucket.
BUCKET_ROWS, BUCKET_DIGITS = 100_000, 2

_SPACES = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Runs of other characters than white space; every run becomes one character, so that no array of words is made."""
    runs = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(runs, _SPACES, "")).cast("long")


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc_id, source, size, *keep)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *keep)


def targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(source, source_size, number, target, quota) of each source of (source, size) rows.

    In the order of cap by weight, sources are at their cap until the level of what is left, by weight, is under the next one's.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = common.checkpointed(sources.withColumn("number", number).withColumn("weight", weight).withColumn("cap", copies * F.col("source_size")).coalesce(1))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    left = sources.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()),
        "capped": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "at": F.row_number().over(order)})
    left = left.withColumn("level", (share * F.col("total") - F.col("capped")) / F.col("weights"))
    level = left.where(F.col("cap") >= F.col("level") * F.col("weight")).agg(F.min_by("level", "at")).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")) if level is not None else F.col("cap").cast("double")
    out = sources.withColumn("target", target)
    return common.small(out.select("source", "source_size", "number", "target", F.floor(F.col("target") + 0.5).alias("quota")))


def block_words(total: int, share: float = SHARE, least: int = BLOCK_WORDS, most: int = MAX_BLOCKS) -> int:
    return max(least, math.ceil(share * total / most))


def placed(rows: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with their source's columns and ``start``, the words before a document in its source, by a hash of doc_id."""
    digits = max(BUCKET_DIGITS, math.ceil(math.log(max(1, n_rows / BUCKET_ROWS), 16)))
    rows = rows.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.where("size > 0").withColumn("hash", F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("bucket", F.conv(F.substring("hash", 1, digits), 16, 10).cast("long"))
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("number", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("number", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("base") + F.sum("size").over(within) - F.col("size")
    return rows.join(base, ["number", "bucket"]).withColumn("start", start).drop("hash", "bucket", "base")


def _epoch_quota(epoch: int) -> Column:
    return F.least(F.greatest(F.col("quota") - epoch * F.col("source_size"), F.lit(0)), F.col("source_size"))


def _block_quota(block: int, copies: int) -> Column:
    return sum((F.ceil(_epoch_quota(e) / block) for e in range(copies)), F.lit(0).cast("long"))


def pieces(rows: DataFrame, block: int, copies: int = COPIES) -> DataFrame:
    """The pieces of each placed document that the quotas take: (*rows, place, first_word, n_words), place in the source's drawing order."""
    full, block_at = F.floor(F.col("source_size") / block), F.col("block") * block
    blocks = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    found, earlier = [], F.lit(0).cast("long")
    for epoch in range(copies):
        quota, some = _epoch_quota(epoch), F.greatest(full, F.lit(1))
        turned = F.pmod(F.col("block") * F.pmod(F.lit(PRIME), some) + epoch * STEP, some)
        at = F.when(F.col("block") < full, turned).otherwise(full)  # the last, shorter block is drawn last
        taken = F.least(F.lit(block), F.greatest(F.lit(0), quota - at * block))
        low, high = F.greatest(block_at, F.col("start")), F.least(block_at + taken, F.col("start") + F.col("size"))
        found.append(F.struct((earlier + at).alias("place"), (low - F.col("start")).alias("first_word"), (high - low).alias("n_words")))
        earlier = earlier + F.ceil(quota / block)
    out = blocks.withColumn("piece", F.explode(F.array(*found))).where("piece.n_words > 0")
    return out.select(*rows.columns, "piece.place", "piece.first_word", "piece.n_words")


def split(quotas: np.ndarray, shards: int, first: int, last: int, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(from, to) of each source's drawing order for the shards ``first`` to ``last`` of ``shards``."""
    total, out = int(quotas.sum()), []

    def node(a: int, b: int, held: np.ndarray, before: np.ndarray) -> None:
        if b <= first or a >= last:
            return
        if b - a == 1:
            out.append((before, before + held))
            return
        middle = (a + b) // 2
        rng = np.random.default_rng([seed, shards, a, b])
        left = rng.multivariate_hypergeometric(held, middle * total // shards - a * total // shards, method="marginals")
        node(a, middle, left, before)
        node(middle, b, held - left, before + left)

    node(0, shards, quotas, np.zeros_like(quotas))
    return out


def ranges(spark, quotas: np.ndarray, shards: int) -> DataFrame:
    """(number, shard, from, to) of each source and shard that has blocks of it."""
    held = spark.sparkContext.broadcast(quotas)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):
                for shard, (a, b) in enumerate(split(held.value, shards, int(ids[0]), int(ids[-1]) + 1), int(ids[0])):
                    some = np.flatnonzero(b > a)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), shard)), pa.array(a[some]), pa.array(b[some])], ["number", "shard", "from", "to"])

    return spark.range(0, shards, 1, max(1, -(-shards // 1024))).mapInArrow(run, "number long, shard long, `from` long, `to` long")


def drawn(docs: DataFrame, text: bool = False, block_least: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the pieces drawn with their ``shard``, all documents of size 0, placed documents); with ``text``, pieces hold their words."""
    keep = ["text"] if text else []
    rows = sized(docs, keep)
    rows = rows if text else common.checkpointed(rows)
    sources = targets(rows)
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_sources = sources.count()
    if n_sources > MAX_SOURCES:
        raise ValueError(f"{n_sources} sources; at most {MAX_SOURCES} can be mixed")
    block = block_words(total, least=block_least)
    with_place = placed(rows, sources, n_rows)
    with_place = with_place if text else common.checkpointed(with_place)
    found = pieces(with_place, block)
    if text:
        words = F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]++", " ")), " ")
        found = found.withColumn("text", F.array_join(F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " "))
    quotas = np.zeros(n_sources, np.int64)
    for number, blocks in sources.select("number", _block_quota(block, COPIES)).collect():
        quotas[number] = blocks
    shards = max(1, int(quotas.sum()) * block // shard_words)
    # both sides meet in cells of a source's drawing order, each about as long as a shard's range in the mean
    width = F.greatest(F.lit(1), F.floor(_block_quota(block, COPIES) / shards))
    dealt = ranges(docs.sparkSession, quotas, shards).join(sources.select("number", width.alias("width")), "number")
    cells = F.sequence(F.floor(F.col("from") / F.col("width")), F.floor((F.col("to") - 1) / F.col("width")))
    dealt = dealt.select("number", "shard", "from", "to", F.explode(cells).alias("cell"))
    found = found.withColumn("cell", F.floor(F.col("place") / width)).join(dealt, ["number", "cell"])
    found = found.where("place >= from AND place < to").drop("cell", "from", "to")
    empty = rows.where("size = 0").join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return found, empty, with_place


def mix(docs: DataFrame, block_least: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, position, doc_id, source, first_word, n_words, text): the mixed corpus, every shard in its own shuffled order."""
    found, _, _ = drawn(docs, True, block_least, shard_words)
    order = Window.partitionBy("shard").orderBy(F.xxhash64("number", "place", "start", F.lit(SEED)), "number", "place", "start")
    found = found.withColumn("position", F.row_number().over(order) - 1)
    return found.select("shard", "position", "doc_id", "source", "first_word", "n_words", "text")


def taken(docs: DataFrame, block_least: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document: the words that all shards have of it."""
    found, empty, with_place = drawn(docs, False, block_least, shard_words)
    one = ["doc_id", "number", "start", "size", "source_size", "target"]
    summed = found.select(*one, "n_words").unionByName(with_place.select(*one, F.lit(0).cast("long").alias("n_words")))
    summed = summed.groupBy(*one).agg(F.sum("n_words").alias("taken"))
    plain = ["doc_id", "size", "source_size", "target", "taken"]
    return summed.select(plain).unionByName(empty.withColumn("taken", F.lit(0).cast("long")).select(plain))


def query(spark, sf_dir: str) -> DataFrame:
    return taken(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


#: The same places and blocks by plain windows; the tree deals blocks to shards and doesn't change what is taken.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
s1 AS (SELECT *, 2 * source_size AS cap, [5, 2, 1][1 + number % 3] AS weight FROM s0),
s2 AS (
  SELECT *, row_number() OVER o AS turn, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(sum(cap) OVER o - cap AS DOUBLE)) / CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS DOUBLE) AS level
  FROM s1 WINDOW o AS (ORDER BY cap / weight, number ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min_by(level, turn) AS level FROM s2 WHERE cap >= level * weight),
s AS (
  SELECT source, source_size, number, coalesce(least(CAST(cap AS DOUBLE), l.level * weight), CAST(cap AS DOUBLE)) AS target FROM s1, l),
b AS (SELECT greatest({BLOCK_WORDS}, CAST(ceil(1.5 * sum(size) / {MAX_BLOCKS}) AS BIGINT)) AS w FROM d),
p AS (
  SELECT row_number() OVER () AS r, doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS quota, w, source_size // w AS f,
    CAST(sum(size) OVER (PARTITION BY number ORDER BY md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, b),
x AS (SELECT *, unnest(range(start // w, (start + size - 1) // w + 1)) AS block FROM p WHERE size > 0),
e AS (
  SELECT *, CASE WHEN block < f THEN (block * ({PRIME} % f) + e * {STEP}) % f ELSE f END AS place,
    CASE WHEN e = 0 THEN least(quota, source_size) ELSE quota - least(quota, source_size) END AS q
  FROM x, (SELECT unnest([0, 1]) AS e)),
t AS (
  SELECT r, CAST(sum(greatest(0, least(block * w + least(w, greatest(0, q - place * w)), start + size) - greatest(block * w, start))) AS BIGINT) AS taken
  FROM e GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM p LEFT JOIN t USING (r)
"""
