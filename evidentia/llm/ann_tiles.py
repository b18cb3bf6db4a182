"""Operator 2, nearest neighbours by cosine: a block matrix join with int8 product tiles and exact recomputation.

The queries are cut to slices of at most ``SLICE_BYTES``, each broadcast once; the candidates stay where they are and
stream past them, so that no vector is shuffled but those of repeated ids. A block of candidates is quantised once and meets
each block of queries in a tile: unit vectors rounded to int8 give products whose error is bounded by the vectors' own
rounding errors (Cauchy-Schwarz), so every pair whose upper bound is below the lower bounds of k others is out. The
pairs that survive are computed again in double precision on the original vectors and kept in one heap of k for each
query, which runs on through the blocks of a task; the heaps of different tasks merge in a ranked window, whose groups
are cut to k before the shuffle. The search is exact.

At most k + 1 copies of one vector in a block can be among a query's nearest, those of smallest id, so further copies
leave the block. More queries take more passes over the candidates, not larger broadcasts or tiles; the number of
tiles is that of the stated queries against all.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows of null id, take no part
on either side; vectors of different lengths are never compared; rows that repeat an id count once, with the least
vector; fewer candidates than k give fewer rows; ties go to the smaller id; other columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

QUERY_BLOCK, CANDIDATE_BLOCK, SLICE_BYTES = 1024, 2048, 16 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec, dim), one row for each id with a usable vector; only ids that repeat are grouped."""
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & some)
    again = common.small(kept.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    least = kept.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return kept.join(again, "vec_id", "left_anti").unionByName(least).withColumn("dim", F.size("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _slices(asked: DataFrame, slice_bytes: int):
    """(dim, ids, vectors) of the queries, at most about ``slice_bytes`` of doubles at a time."""
    for dim, n in sorted(tuple(r) for r in asked.groupBy("dim").count().collect()):
        parts = max(1, -(-n * dim * 8 // slice_bytes))
        for k in range(parts):
            mine = asked.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k)).select("vec_id", "vec").toArrow()
            yield dim, mine.column("vec_id").to_numpy(), _matrix(mine.column("vec"), dim)


def quantised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, their scales, error norms) of the rows' unit vectors."""
    top = np.abs(matrix).max(1)
    scaled = matrix / top[:, None]  # so that no square overflows or vanishes
    unit = scaled / np.sqrt((scaled * scaled).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1))
    return q, scale, error


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows; 1,000 components at a time stay below 2^24, which float32 holds exactly."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1000):
        out += a[:, k : k + 1000].astype(np.float32) @ b[:, k : k + 1000].astype(np.float32).T
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, safe for very large and very small components."""
    a, b = a / np.abs(a).max(1)[:, None], b / np.abs(b).max(1)[:, None]
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Block:
    """Candidates in ascending order of ids, without copies that can't count, and quantised."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, group = np.unique(vectors, axis=0, return_inverse=True)
        order = np.argsort(group.reshape(-1), kind="stable")
        run = group.reshape(-1)[order]
        keep = np.sort(order[np.arange(len(run)) - np.searchsorted(run, run) <= k])
        self.ids, self.vectors = ids[keep], vectors[keep]
        self.q, self.scale, self.error = quantised(self.vectors)


class Queries:
    """A slice of queries, quantised, with their heaps of (score, -vec_id)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.q, self.scale, self.error = quantised(vectors)
        self.heaps, self.floor = [[] for _ in ids], np.full(len(ids), -np.inf)

    def tile(self, a: int, b: int, block: Block) -> None:
        """The pairs of queries a to b with a block's candidates into the heaps."""
        part = slice(a, b)
        near = _products(self.q[part], block.q) * self.scale[part, None] * block.scale[None]
        slack = self.error[part, None] + (1 + self.error[part, None]) * block.error[None] + 1e-12
        own = self.ids[part, None] == block.ids[None]
        low = np.where(own, -2, near - slack)
        n = min(self.k, len(block.ids))
        floor = np.maximum(np.partition(low, len(block.ids) - n, 1)[:, len(block.ids) - n], self.floor[part])
        rows, columns = np.nonzero((near + slack >= floor[:, None]) & ~own)
        for c in range(0, len(rows), 1 << 16):
            r, v = rows[c : c + (1 << 16)] + a, columns[c : c + (1 << 16)]
            scores = cosine(self.vectors[r], block.vectors[v])
            for q, x, s in zip(r.tolist(), block.ids[v].tolist(), scores.tolist(), strict=True):
                heap = self.heaps[q]
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -x))
                elif (s, -x) > heap[0]:
                    heapq.heapreplace(heap, (s, -x))
                if len(heap) == self.k:
                    self.floor[q] = heap[0][0] - 1e-9


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of the rows whose vec_id meets ``is_query``."""
    spark = vectors.sparkSession
    rows = common.checkpointed(usable(vectors, id_col, vector_col))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    found = spark.createDataFrame([], schema)
    for dim, ids, matrix in _slices(rows.where(is_query), slice_bytes):
        held = spark.sparkContext.broadcast((ids, matrix))

        def run(batches, held=held, dim=dim):
            queries = Queries(*held.value, k)
            for whole in batches:
                for a in range(0, whole.num_rows, candidate_block):
                    batch = whole.slice(a, candidate_block)
                    block = Block(batch.column(0).to_numpy(), _matrix(batch.column(1), dim), k)
                    for b in range(0, len(queries.ids), query_block):
                        queries.tile(b, b + query_block, block)
            out = [(q, -v, s) for q, heap in zip(queries.ids.tolist(), queries.heaps, strict=True) for s, v in heap]
            for a in range(0, len(out), 10_000):
                q, v, s = zip(*out[a : a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=schema.names)

        found = found.unionByName(rows.where(F.col("dim") == dim).select("vec_id", "vec").mapInArrow(run, schema))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
