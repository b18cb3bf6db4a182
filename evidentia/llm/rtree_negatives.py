"""Operator 12, hard-negative mining: STR-packed R-trees of integer vectors, searched best-first by score windows.

The vectors are dealt by ranges of label, first component and id, so that a label or a vector with a third of the rows is cut
to many tasks. A task packs up to ``TREE_ROWS`` rows at a time into an R-tree by sort-tile-recursive order: the rows are cut to
slabs by one component after the other, those that vary most first, down to leaves of ``LEAF`` rows; ``FANOUT`` neighbouring
nodes make the node above. A node's box has the least and largest value of each component, which give an interval of
each anchor's inner product component by component, and the least and largest label and the least id. An anchor's queue takes the
box of the largest upper bound first. A box is pruned if its interval misses every score window of the anchor, or its upper
bound is strictly below the k-th score found there, or equal to it with no smaller id to offer. A third of all rows may
be one vector: those boxes are points of one score, of which only the first ids are opened.

Two searches: the positives of each anchor, among the rows of its label; then the rows of other labels in one window for each
distinct score of its positives. The k best of a window run on through the trees of a task; tasks send at most k rows a
window, merged by a ranked window. Anchors are broadcast in slices of ``SLICE_BYTES``; each slice is one more pass that appends to
one table, so that neither the broadcast nor the plan grows. Scores are exact integers.

Defined results: rows of null id, null label, null or empty vector, or a null or non-finite component take no part, and
neither do rows with a component of ``LIMIT`` or more in size, whose products don't fit in 64 bits; vectors of different lengths
are never compared; rows that repeat an id count once, with the least vector and label; an anchor without other rows of its
label has no rows, nor has a positive of negative score, whose window is empty; other columns aren't read.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, LOW, HIGH = 5, 80, 100
LEAF, FANOUT, TREE_ROWS, ANCHOR_BLOCK, SLICE_BYTES = 64, 8, 16_384, 256, 16 << 20
#: Components of this size and more are out: 256 times as much, squared and summed over 1,024 components, is the last below 2^63.
LIMIT = 2**18
_NO_ID = np.iinfo(np.int64).max


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec of longs, dim), one row for each id that takes part."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    fits = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LIMIT)))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & fits)
    kept = kept.select("vec_id", "label", F.transform("vec", lambda x: F.floor(F.lit(256.0) * x)).alias("vec"))
    again = common.small(kept.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    least = kept.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("vec", "label")).alias("b")).select("vec_id", "b.label", "b.vec")
    return kept.join(again, "vec_id", "left_anti").unionByName(least).withColumn("dim", F.size("vec"))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` by ranges of label, first component and id, written once; no key holds a range together."""
    return common.checkpointed(rows.repartitionByRange("dim", "label", F.element_at("vec", 1), "vec_id"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b exactly: in doubles where no sum can pass 2^53, else in 64-bit integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if bound < 2**53 else a @ b


def str_order(labels: np.ndarray, vectors: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort-tile-recursive order of the rows and the starts of its leaves; leaves hold one label where labels fill leaves."""
    by_label = np.argsort(labels, kind="stable")
    runs = np.flatnonzero(np.r_[True, np.diff(labels[by_label]) != 0])
    parts = np.split(by_label, runs[1:]) if len(runs) * leaf <= len(labels) else [by_label]
    done: list[np.ndarray] = []

    def tile(rows: np.ndarray, axes: list[int]) -> None:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or not axes:
            done.extend(rows[k : k + leaf] for k in range(0, len(rows), leaf))
            return
        rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
        slabs = max(2, round(pages ** (1 / len(axes))))
        size = leaf * -(-pages // slabs)
        for k in range(0, len(rows), size):
            tile(rows[k : k + size], axes[1:])

    for rows in parts:
        pages = -(-len(rows) // leaf)
        spread = np.argsort(-vectors[rows].std(0), kind="stable")
        tile(rows, spread[: max(1, (pages - 1).bit_length())].tolist())
    return np.concatenate(done), np.cumsum([0] + [len(x) for x in done[:-1]])


class Tree:
    """An R-tree of rows of one length; nodes of all levels stand in one array, leaves first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        order, starts = str_order(labels, vectors, leaf)
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.leaves, ends = len(starts), np.r_[starts[1:], len(order)]
        low, high = np.minimum.reduceat(self.vectors, starts), np.maximum.reduceat(self.vectors, starts)
        first_label, last_label = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        least = np.minimum.reduceat(self.ids, starts)
        levels, spans, below = [(low, high, first_label, last_label, least)], [np.stack([starts, ends], 1)], 0
        while len(levels[-1][0]) > fanout:
            n = len(levels[-1][0])
            at = np.arange(0, n, fanout)
            ops = (np.minimum, np.maximum, np.minimum, np.maximum, np.minimum)
            levels.append(tuple(op.reduceat(x, at) for op, x in zip(ops, levels[-1], strict=True)))
            spans.append(below + np.stack([at, np.minimum(at + fanout, n)], 1))
            below += n
        self.tops = range(below, below + len(levels[-1][0]))
        self.low, self.high, self.first_label, self.last_label, self.least = (np.concatenate(x) for x in zip(*levels, strict=True))
        self.spans = np.concatenate(spans)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) inner product of each anchor with a vector in each node's box."""
        plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return products(plus, self.low.T) + products(minus, self.high.T), products(plus, self.high.T) + products(minus, self.low.T)


class Windows:
    """An anchor's score windows with the k best (score, -id) of each."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k, self.heaps = low, high, k, [[] for _ in low]
        self.floor, self.last = low.copy(), np.full(len(low), _NO_ID)  # what a row must reach, and the id it must be under if equal

    def open(self, low, high, least) -> np.ndarray:
        """Windows for which a box of such bounds may have a row."""
        return (low <= self.high) & ((high > self.floor) | (high == self.floor) & (least < self.last))

    def offer(self, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> None:
        for w in np.flatnonzero(wanted):
            heap = self.heaps[w]
            for i in np.flatnonzero((scores >= self.floor[w]) & (scores <= self.high[w])):
                new = (int(scores[i]), -int(ids[i]))
                if len(heap) < self.k:
                    heapq.heappush(heap, new)
                elif new > heap[0]:
                    heapq.heapreplace(heap, new)
            if len(heap) == self.k:
                self.floor[w], self.last[w] = heap[0][0], -heap[0][1]


def explore(tree: Tree, anchor: np.ndarray, own_id: int, label: int, same: bool, low: np.ndarray, high: np.ndarray, windows: Windows) -> int:
    """Best-first search of a tree for one anchor, whose bounds with every node are ``low`` and ``high``; how many leaves were opened."""
    fits = (tree.first_label <= label) & (tree.last_label >= label) if same else (tree.first_label != label) | (tree.last_label != label)
    most, opened = int(windows.high.max()), 0
    queue = [(-min(int(high[n]), most), int(tree.least[n]), n) for n in tree.tops if fits[n]]
    heapq.heapify(queue)
    while queue:
        _, _, node = heapq.heappop(queue)
        wanted = windows.open(low[node], high[node], tree.least[node])
        if not wanted.any():
            if high[node] < windows.floor.min():
                break  # nor has any other box of the queue
            continue
        a, b = tree.spans[node]
        if node < tree.leaves:
            take = (tree.labels[a:b] == label) == same
            take &= tree.ids[a:b] != own_id
            windows.offer(products(tree.vectors[a:b][take], anchor), tree.ids[a:b][take], wanted)
            opened += 1
        else:
            for n in range(a, b):
                if fits[n] and windows.open(low[n], high[n], tree.least[n]).any():
                    heapq.heappush(queue, (-min(int(high[n]), most), int(tree.least[n]), n))
    return opened


def _trees(batches, dim: int, rows: int):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def searched(rows: DataFrame, anchors: DataFrame, same: bool, k: int, tree_rows: int = TREE_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(anchor_id, window, vec_id, score) of each task's k best in each of the anchors' ``windows``, arrays of (window, low, high)."""
    spark = rows.sparkSession
    path, schema = f"{common.shared_dir(spark)}/found-{uuid.uuid4().hex}", "anchor_id long, window long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for dim, n, n_windows in sorted(tuple(r) for r in anchors.groupBy("dim").agg(F.count("*"), F.sum(F.size("windows"))).collect()):
        parts = max(1, -(-(n * (dim + 2) + 3 * n_windows) * 8 // slice_bytes))
        for part in range(parts):
            mine = anchors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part))
            held = spark.sparkContext.broadcast(mine.select("vec_id", "label", "vec", "windows").toArrow())

            def run(batches, held=held, dim=dim):
                asked = held.value
                ids, labels, vectors = asked.column(0).to_numpy(), asked.column(1).to_numpy(), _matrix(asked.column(2), dim)
                listed = [np.array([(w["window"], w["low"], w["high"]) for w in r], np.int64).reshape(-1, 3) for r in asked.column(3).to_pylist()]
                windows = [Windows(w[:, 1].copy(), w[:, 2].copy(), k) for w in listed]
                for part in _trees(batches, dim, tree_rows):
                    tree = Tree(part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), dim))
                    for a in range(0, len(ids), ANCHOR_BLOCK):
                        low, high = tree.bounds(vectors[a : a + ANCHOR_BLOCK])
                        for i in range(len(low)):
                            explore(tree, vectors[a + i], int(ids[a + i]), int(labels[a + i]), same, low[i], high[i], windows[a + i])
                out = [(i, w, -v, s) for i, ws, found in zip(ids.tolist(), listed, windows, strict=True) for w, heap in zip(ws[:, 0].tolist(), found.heaps, strict=True) for s, v in heap]
                for a in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a : a + 10_000], strict=True)], ["anchor_id", "window", "vec_id", "score"])

            rows.where(F.col("dim") == dim).select("vec_id", "label", "vec").mapInArrow(run, schema).write.mode("append").parquet(path)
    best = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return spark.read.parquet(path).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, k_positive: int = K, k_negative: int = K, low: int = LOW, high: int = HIGH, tree_rows: int = TREE_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, embedding) rows.

    A negative's score is from ``low`` to ``high`` hundredths of its positive's.
    """
    rows = dealt(quantised(vectors))
    anchors = rows.where(is_anchor)
    span = np.iinfo(np.int64)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(int(span.min)).alias("low"), F.lit(int(span.max)).alias("high")))
    positives = searched(rows, anchors.withColumn("windows", everything), True, k_positive, tree_rows, slice_bytes)
    positives = common.checkpointed(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    least, most = (F.expr(f"CAST({way}(CAST(positive_score AS DECIMAL(20, 0)) * {share} / 100) AS BIGINT)") for way, share in (("ceil", low), ("floor", high)))
    windows = positives.select("anchor_id", F.col("positive_score").alias("window"), least.alias("low"), most.alias("high")).where("low <= high")
    windows = windows.groupBy("anchor_id").agg(F.collect_set(F.struct("window", "low", "high")).alias("windows"))
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    negatives = searched(rows, asked, False, k_negative, tree_rows, slice_bytes)
    negatives = negatives.select("anchor_id", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.join(negatives, ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    """Hard negatives for the rows whose vec_id is divisible by 100; where it is divisible by 7 the label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return mine(vectors, F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {LIMIT})) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
g AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM p WHERE same) WHERE r <= 5),
n AS (
  SELECT g.*, p.vec_id AS negative_id, p.score AS negative_score,
    row_number() OVER (PARTITION BY g.anchor_id, g.positive_id ORDER BY p.score DESC, p.vec_id) AS rank
  FROM g JOIN p USING (anchor_id) WHERE NOT p.same AND 80 * positive_score <= 100 * p.score AND 100 * p.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
