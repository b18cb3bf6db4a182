"""What the operators share: table reading, settings, sampling of labelled rows, byte views of Arrow text."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that numpy works on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a new one of our own in a local session, and an error on a cluster."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get()


def added(docs: DataFrame, fields: list[T.StructField], drop: tuple = ()) -> T.StructType:
    """The columns of ``docs`` but for ``drop``, and ``fields``; a column of a new one's name (in any case) is an error, never two of one name."""
    kept = [f for f in docs.schema.fields if f.name not in drop]
    clash = sorted({f.name.lower() for f in kept} & {f.name.lower() for f in fields})
    if clash:
        raise ValueError(f"rename these columns of the input, the operator adds columns of their names: {', '.join(clash)}")
    return T.StructType([*kept, *fields])


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder: lineage ends there and lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of our own that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: What a task reads or sends to Python at once: rows of a Parquet batch, and bytes of an Arrow batch.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches that stay small however long the texts are.

    The session's settings of the two are lowered to BATCHES, unless it has others than Spark's defaults.
    """
    conf = df.sparkSession.conf
    for key, value in BATCHES.items():
        if conf.get(key) in ("4096", "67108864b"):
            conf.set(key, value)
    return df.mapInArrow(run, schema)


#: Rows of keys that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def small(rows: DataFrame) -> DataFrame:
    """``rows`` of a few numbers each, computed once and counted: marked for broadcast up to BROADCAST_ROWS, plain beyond."""
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, rows: int, max_chars: int) -> list:
    """Up to ``rows`` labelled rows outside the held-out fold, half of each label where there are enough.

    The bound is ``rows`` documents of at most ``max_chars`` characters each, the first in the order of a hash of
    doc_id, so that the driver's memory doesn't grow with the corpus. Null labels and ids take no part.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % fold != held_out))
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("label")).withColumn("order", F.xxhash64("doc_id"))
    picked = [ids.where(F.col("label") == value).orderBy("order", "doc_id").limit(rows // 2) for value in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # at most ``rows`` rows of three numbers, so that it can be broadcast
    known = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # one text for each id, of equal ids the first by a hash: combined before the shuffle, at most ``rows`` in all
    known = known.groupBy("doc_id", "label", "order").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("b"))
    found = known.select("doc_id", "b.text", "label", "order").collect()
    return sorted(found, key=lambda r: (r["order"], r["doc_id"]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and its n + 1 offsets; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges [a, b) of rows with at most ``limit`` bytes, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int):
    """(first text, its pieces' offsets) of at most about ``limit`` bytes; a longer text is cut between words of ``ALNUM``."""
    for a, b in chunks(offsets, limit):
        at = offsets[a]
        while b == a + 1 and offsets[b] - at > limit:
            cut = at + limit
            while cut < offsets[b]:
                gap = np.flatnonzero(~ALNUM[data[cut : min(cut + limit, offsets[b])]])
                if len(gap):
                    cut += gap[0]
                    break
                cut = min(cut + limit, offsets[b])
            yield a, np.array([at, cut])
            at = cut
        yield a, np.r_[at, offsets[a + 1 : b + 1]]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2^64 and their inverses."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for k, base in ((0, _ODD), (1, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` has the hash of any span of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_tables(len(data))[0], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def span_sum(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span, not mixed yet, so that ``joined`` has that of two spans together."""
    return (sums[end] - sums[start]) * _power_tables(len(sums))[1][start]


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each span; equal bytes have equal hashes wherever they stand."""
    return mix(span_sum(sums, start, end))


def joined(first: np.uint64, size: int, second: np.uint64) -> np.uint64:
    """The ``span_sum`` of a span of ``size`` bytes with another behind it."""
    return np.uint64((int(first) + pow(int(_ODD), int(size), 1 << 64) * int(second)) % (1 << 64))


#: Bytes of words of letters and digits: ASCII ones, and all that UTF-8 has beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are ``inside``, by default not white space; no run crosses an offset."""
    word = inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
