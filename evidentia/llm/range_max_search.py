"""Operator 13, ranked lexical search: range-maximum sparse tables over posting lists, best-first document intervals.

A first pass counts, in each document, its terms and those of them that some item asks for; the counts are written once and
give N, L and every df. The second pass cuts the counted documents to shards of at most ``SHARD_POSTINGS`` postings, each in
one task: a posting's impact is what its term adds to its document's score, and a sparse table over each posting list has the
largest impact of any range of it in two reads. A document interval is bounded by the sum of those maxima over the item's
terms. Intervals wait in a queue, largest bound first; one is taken out and split at the document of the largest single impact,
which is scored, and both sides go back with their own bounds. An interval of few postings is scored whole. An item ends where
no bound reaches its k-th score; equal bounds are looked at, so that ties go to the smaller doc_id. The k best of an item
run on through the shards of a task; tasks send k rows an item, which a ranked window merges. The search is exact.

No posting and no text is shuffled. Items are broadcast in slices of at most ``SLICE_WORDS`` words, each slice one more pass over
the documents that appends to one table; so neither the broadcast nor the plan grows with the items. A text of over
``common.CHUNK_BYTES`` goes through in blocks cut between words; an item's own words are held whole.

Defined results: null texts and texts without a term aren't found and don't count in N; each row is a document of its own, so
rows that repeat a doc_id are ranked each; a null doc_id comes after all others of its score; equal items count once, items
that share an id but not their text are ranked each by itself; an item without terms, or none of whose terms is in a document,
has no rows; without documents there are none; other columns aren't read.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, native

K = 10
#: Words of items that one pass looks for; postings of a shard; postings of an interval that is scored whole; intervals taken at once.
SLICE_WORDS, SHARD_POSTINGS, LEAF_POSTINGS, TAKEN = 500_000, 1_000_000, 400, 32
FOUND = "item long, item_id long, doc_id long, score long"


class Terms:
    """Distinct terms in the order of their hashes, with their bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        lengths = np.array([len(t) for t in terms], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        hashes = common.span_hash(common.prefix_hash(data), starts, ends)
        order = np.argsort(hashes, kind="stable")
        self.data, self.hashes, self.starts, self.lengths = data, hashes[order], starts[order], lengths[order]
        self.number = {terms[k]: i for i, k in enumerate(order)}

    def find(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words, which term) of the words that are terms, compared byte by byte."""
        if not len(self.hashes) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = common.span_hash(common.prefix_hash(low), start, end)
        term = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        word = np.flatnonzero((self.hashes[term] == h) & (self.lengths[term] == end - start))
        term = term[word]
        n = self.lengths[term]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = low[np.repeat(start[word], n) + step] != self.data[np.repeat(self.starts[term], n) + step]
        if other.any():
            same = np.ones(len(word), bool)
            same[np.repeat(np.arange(len(word)), n)[other]] = False
            word, term = word[same], term[same]
        return word, term


def counted(data: np.ndarray, offsets: np.ndarray, terms: Terms, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of words, and (text, term, tf) of the terms found, by text and term."""
    n, keys, tfs = np.zeros(len(offsets) - 1, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    width = max(1, len(terms.hashes))
    for first, part in common.blocks(data, offsets, limit or common.CHUNK_BYTES):
        low, local = common.lower_ascii(data[part[0] : part[-1]]), part - part[0]
        start, end = common.word_spans(low, local, common.ALNUM)
        text = np.searchsorted(local, start, "right") - 1
        n[first : first + len(part) - 1] += np.bincount(text, minlength=len(part) - 1)
        word, term = terms.find(low, start, end)
        key, tf = np.unique((first + text[word]) * width + term, return_counts=True)
        keys.append(key)
        tfs.append(tf)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.zeros(len(key), np.int64)
    np.add.at(tf, where, np.concatenate(tfs))
    return n, key // width, key % width, tf


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class Shard:
    """Posting lists by term over documents numbered within the shard, and sparse tables of their largest impacts."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_words: int):
        m = 100 - 75 + (75 * n * n_docs) // n_words
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        # documents with the same strongest term stand together, so that intervals hold fewer of an item's terms
        strong = np.full(len(n), -1, np.int64)
        by = np.argsort(impact, kind="stable")
        strong[doc[by]] = term[by]
        self.rows = np.argsort(strong, kind="stable")
        place = np.empty(len(n), np.int64)
        place[self.rows] = np.arange(len(n))
        self.width, order = max(1, len(n)), np.lexsort((place[doc], term))
        self.doc, self.impact = place[doc][order], impact[order]
        self.key = term[order] * self.width + self.doc
        self.ends = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.table = [np.arange(len(order), dtype=np.int32)]
        longest = int(np.diff(self.ends).max(initial=0))
        while 2 << (len(self.table) - 1) <= longest:
            below, half = self.table[-1], 1 << (len(self.table) - 1)
            a, b = below, np.r_[below[half:], np.full(min(half, len(below)), below[-1])]
            self.table.append(np.where(self.impact[b] > self.impact[a], b, a).astype(np.int32))
        self.table = np.stack(self.table)

    def top(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The posting of largest impact of each range, or -1 of an empty one."""
        n = np.maximum(high - low, 1)
        level = np.frexp(n.astype(np.float64))[1] - 1
        a, last = np.minimum(low, len(self.impact) - 1), np.maximum(high - (1 << level), 0)
        a, b = self.table[level, a], self.table[level, np.minimum(last, len(self.impact) - 1)]
        return np.where(high > low, np.where(self.impact[b] > self.impact[a], b, a), -1)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
        """All documents that reach the k best of one item; how many documents were scored."""
        if not len(self.impact):
            return 0
        base, scored = terms * self.width, 0
        queue: list = []

        def push(low: np.ndarray, high: np.ndarray) -> None:
            if not len(low):
                return
            top = self.top(low, high)
            gain = np.where(top >= 0, self.impact[top], 0) * times
            bound = gain.sum(1)
            largest = top[np.arange(len(top)), gain.argmax(1)]
            for i in np.flatnonzero((bound > 0) & (bound >= best.floor)):
                heapq.heappush(queue, (-int(bound[i]), int(largest[i]), low[i], high[i]))

        push(self.ends[terms][None], self.ends[terms + 1][None])
        while queue and -queue[0][0] >= best.floor:
            taken = [heapq.heappop(queue) for _ in range(min(TAKEN, len(queue))) if -queue[0][0] >= best.floor]
            low, high = np.stack([t[2] for t in taken]), np.stack([t[3] for t in taken])
            few = (high - low).sum(1) <= LEAF_POSTINGS
            if few.any():
                a, n = low[few].ravel(), (high - low)[few].ravel()
                at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                gain = self.impact[at] * np.repeat(np.tile(times, int(few.sum())), n)
                order = np.argsort(self.doc[at], kind="stable")
                docs, first = np.unique(self.doc[at][order], return_index=True)
                best.offer(self.rows[docs], np.add.reduceat(gain[order], first))
                scored += len(docs)
            low, high, doc = low[~few], high[~few], self.doc[[t[1] for t, f in zip(taken, few, strict=True) if not f]].astype(np.int64)
            if len(low):
                want = base[None] + doc[:, None]
                split = np.searchsorted(self.key, want)
                here = self.key[np.minimum(split, len(self.key) - 1)] == want
                best.offer(self.rows[doc], (np.where(here, self.impact[np.minimum(split, len(self.key) - 1)], 0) * times).sum(1))
                scored += len(doc)
                push(np.r_[low, split + here], np.r_[split, high])
        return scored


class Best:
    """The k best (score, doc_id) of an item; ``floor`` is what a document must reach."""

    def __init__(self, k: int):
        self.k, self.heap, self.floor, self.ids = k, [], 1, None

    def offer(self, rows: np.ndarray, scores: np.ndarray) -> None:
        for i in np.flatnonzero(scores >= self.floor):
            doc_id = self.ids[rows[i]]
            new = (int(scores[i]), float("-inf") if doc_id is None else -doc_id, doc_id)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, new)
            elif new[:2] > self.heap[0][:2]:
                heapq.heapreplace(self.heap, new)
            if len(self.heap) == self.k:
                self.floor = max(1, self.heap[0][0])


def _lists(keys: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    ends = np.searchsorted(keys, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def count_terms(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, terms, tfs): every document's number of words, and the numbers of its terms among ``terms`` with their tf."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        for batch in batches:
            n, doc, term, tf = counted(*common.text_bytes(batch.column(1)), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _lists(doc, term, len(n)), _lists(doc, tf, len(n))], ["doc_id", "n", "terms", "tfs"])

    return common.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _shards(batches, most: int):
    """Batches of counted documents, joined to about ``most`` postings."""
    held, n = [], 0
    for batch in batches:
        size = max(1, len(batch.column(2).flatten()) // max(1, most))
        for k in range(size):  # a batch of more is cut
            a, b = batch.num_rows * k // size, batch.num_rows * (k + 1) // size
            part = batch.slice(a, b - a)
            held.append(part)
            n += len(part.column(2).flatten())
            if n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _found(rows: DataFrame, asked: list, terms: Terms, weight: np.ndarray, n_docs: int, n_words: int, k: int, shard_postings: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best of each item and task."""
    items = []
    for item, item_id, words in asked:
        number, times = np.unique([terms.number[w.encode()] for w in words], return_counts=True)
        number, times = number[weight[number] > 0], times[weight[number] > 0]
        items.append((item, item_id, number, times))
    held = rows.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches):
        items, weight = held.value
        bests = [Best(k) for _ in items]
        for part in _shards(batches, shard_postings):
            part = part.combine_chunks()
            lists, tfs = (part.column(c).combine_chunks() for c in (2, 3))
            lists, tfs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lists, tfs))
            doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            numbers = [x.flatten().to_numpy().astype(np.int64) for x in (lists, tfs)]
            shard = Shard(part.column(1).to_numpy(), doc, *numbers, weight, n_docs, n_words)
            ids = part.column(0).to_pylist()
            for (_, _, number, times), best in zip(items, bests, strict=True):
                best.ids = ids
                shard.search(number, times, best)
        out = [(item, item_id, doc_id, score) for (item, item_id, _, _), best in zip(items, bests, strict=True) for score, _, doc_id in best.heap]
        for a in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a : a + 10_000], strict=True)], ["item", "item_id", "doc_id", "score"])

    return rows.where(F.size("terms") > 0).mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = K, slice_words: int = SLICE_WORDS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item."""
    spark = docs.sparkSession
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    listed = listed.select("item_id", F.xxhash64("item_id", "text").alias("item"), native.words(F.col("text")).alias("words")).where(F.size("words") > 0)
    listed = common.checkpointed(listed)
    n_words = listed.agg(F.sum(F.size("words"))).first()[0] or 0
    path, parts = f"{common.shared_dir(spark)}/best-{uuid.uuid4().hex}", max(1, -(-n_words // slice_words))
    spark.createDataFrame([], FOUND).write.parquet(path)
    for part in range(parts):
        mine = F.pmod("item", F.lit(parts)) == part
        asked = [(r.item, r.item_id, r.words) for r in listed.where(mine).collect()]
        if not asked:
            continue
        terms = Terms(sorted({w.encode() for _, _, words in asked for w in words}))
        rows = common.written(count_terms(docs, terms), "terms")
        total, length = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms.hashes), np.int64)
        for term, count in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = count
        found = _found(rows, asked, terms, weights(total, df), total, max(1, length), k, shard_postings)
        found.write.mode("append").parquet(path)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = spark.read.parquet(path).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document ranked for every benchmark item."""
    return search(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS l FROM d WHERE len(words) > 0),
i AS (
  SELECT item_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_id, text, w, count(*) AS times FROM (SELECT item_id, text, unnest(words) AS w FROM i) GROUP BY ALL),
p0 AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS w FROM d),
p AS (SELECT r, doc_id, n, w, count(*) AS tf FROM p0 WHERE w IN (SELECT w FROM q) GROUP BY ALL),
g AS (SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY w, n_docs),
x AS (
  SELECT q.item_id, q.text, p.r, p.doc_id, CAST(sum(q.times * g.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * p.n * s.n_docs) // s.l)))) AS BIGINT) AS score
  FROM q JOIN p USING (w) JOIN g USING (w), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""
