"""Operator 8, line dedup: a sharded minimal perfect hash over distinct line hashes indexes compact arrays.

1. Every document gives its distinct long line keys as pairs of 64-bit hashes (place, fingerprint); a grouped count,
   combined before the shuffle, has each distinct pair with its number of documents and its largest doc_id.
2. The distinct hashes are dealt to shards of about ``SHARD_KEYS`` keys. A shard's task builds a minimal perfect hash of
   the places (levels of bits; a key that meets another moves to the next level) and fills arrays by its rank: 32 bits
   of fingerprint, count and keeping document, some 17 bytes a key with the bits. Those bits and arrays are all that
   leaves the task. Places that two keys share are marked in the arrays and stand in a short list beside them.
3. Documents probe the arrays: a line goes where its count is at least ``min_docs`` and another document keeps it.
   An index of at most ``GROUP_BYTES`` is broadcast and the texts are read and rewritten in one pass. A larger one stays
   where it is: the documents' line hashes (not their texts) are dealt to the shards and pass each in batches, a shard
   that many probes want is copied for several tasks, and the hashes of the lines that go are gathered for each text,
   which is read once more and rewritten. Both ways give the same rows.

A false hit needs two lines of equal 96 bits of hash. A text is held as its bytes and 16 bytes a line; only lines that are long
enough for a key become objects.

Defined results: a null or empty text is one empty line; rows that share a doc_id count as one document, and all keep
a line that this doc_id holds last; rows of null doc_id are counted as no document and lose no line; a repeated line
stays as often as it stands in the keeping document; extra columns pass through, and one of a new column's name is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS, GROUP_BYTES = 1 << 17, 64 << 20
#: Bytes of the index for each key, at most, and probes that one task has of one shard, about.
KEY_BYTES, TASK_PROBES = 18, 20_000_000
#: The count that marks a place of several keys.
_SHARED = -1
_WHITE = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The line's key where it is long enough; ASCII letters only are lower-cased."""
    key = line.strip(_WHITE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def long_lines(text: bytes | None, min_chars: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of lines, starts and ends of those of at least ``min_chars`` bytes); 16 bytes a line, whatever the lines hold."""
    data = np.frombuffer(text or b"", np.uint8)
    breaks = np.flatnonzero(data == 10)
    sizes = np.diff(breaks, prepend=-1, append=len(data)) - 1
    which = np.flatnonzero(sizes >= min_chars)
    ends = np.append(breaks, len(data))[which] if len(which) else which
    return len(breaks) + 1, ends - sizes[which], ends


def hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _signed(h: np.ndarray) -> np.ndarray:
    return np.asarray(h, np.uint64).view(np.int64)


def line_keys(docs: DataFrame, min_chars: int, with_text: bool = False) -> DataFrame:
    """(place, fingerprint, doc_id): the distinct hashes of each row's long lines; with_text: and text_hash, the row's text's."""
    names = ["place", "fingerprint", "doc_id"] + ["text_hash"] * with_text
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            out_a, out_b, size = [], [], []
            for text, doc_id in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(_keyed(text, min_chars)[3]) if doc_id is not None else ()
                for a, b in found:
                    out_a.append(a)
                    out_b.append(b)
                size.append(len(found))
            row = np.repeat(np.arange(batch.num_rows), size)
            rest = [batch.column(c).take(pa.array(row)) for c in range(1, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(out_a)), pa.array(_signed(out_b)), *rest], names=names)

    columns = ["text", F.col("doc_id").cast("long")] + [F.xxhash64("text").alias("text_hash")] * with_text
    return common.mapped(docs.select(*columns), run, schema)


def counted(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(place, fingerprint, n_docs, keeper) of every distinct key."""
    per_doc = line_keys(docs, min_chars).groupBy("place", "fingerprint", "doc_id").agg(F.lit(1).alias("one"))
    return per_doc.groupBy("place", "fingerprint").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def _rehash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class Perfect:
    """A minimal perfect hash of distinct 64-bit keys: levels of bits, ranked by running popcounts."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        """sizes: of each level, in bits; bits: all levels, each filled up to whole bytes."""
        self.sizes, self.bits, self.levels, rank, at = list(sizes), bits, [], 0, 0
        for size in self.sizes:
            own = bits[at : at + (size + 7) // 8]
            ones = np.cumsum(np.bitwise_count(own), dtype=np.int32)
            self.levels.append((own, rank + np.r_[np.int32(0), ones[:-1]]))
            rank, at = rank + int(ones[-1]), at + len(own)
        self.n = rank

    @classmethod
    def of(cls, keys: np.ndarray, load: float = 1.6) -> Perfect:
        left, sizes, bits = keys.astype(np.uint64), [], []
        while len(left):
            size = max(64, int(len(left) * load) | 1)
            spot = (_rehash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            used = np.bincount(spot, minlength=size)
            sizes.append(size)
            bits.append(np.packbits(used == 1))
            left = left[used[spot] != 1]
        return cls(sizes, np.concatenate([np.zeros(0, np.uint8), *bits]))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, 0 to n - 1; -1 or any number for a key that isn't indexed."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, ((bits, ranks), size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            spot = (_rehash(keys[todo], level) % np.uint64(size)).astype(np.int64)
            byte, shift = spot >> 3, 7 - (spot & 7)
            hit = (bits[byte] >> shift) & 1 == 1
            before = np.bitwise_count(bits[byte] >> (shift + 1).astype(np.uint8)).astype(np.int64)
            out[todo[hit]] = (ranks[byte] + before)[hit]
            todo = todo[~hit]
        return out


_INDEX = "shard long, probes long, sizes array<long>, bits binary, prints binary, counts binary, keepers binary, shared binary"


def build(keys: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: its hash's levels, its arrays, the keys that share a place, and the probes to expect."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        place, prints, keeper = (frame[c].to_numpy(np.int64) for c in ("place", "fingerprint", "keeper"))
        count = np.minimum(frame["n_docs"].to_numpy(np.int64), 2**31 - 1)
        distinct, first, times = np.unique(place, return_index=True, return_counts=True)
        perfect = Perfect.of(distinct.view(np.uint64))
        at = perfect.index(distinct.view(np.uint64))
        by_rank = np.empty(len(distinct), np.int64)
        by_rank[at] = first
        counts = count[by_rank].astype(np.int32)
        counts[at[times > 1]] = _SHARED
        among = np.isin(place, distinct[times > 1])
        shared = np.stack([x[among] for x in (place, prints, count, keeper)])
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "probes": [int(count.sum())], "sizes": [perfect.sizes], "bits": [perfect.bits.tobytes()], "prints": [prints[by_rank].astype(np.int32).tobytes()], "counts": [counts.tobytes()], "keepers": [keeper[by_rank].tobytes()], "shared": [shared.tobytes()]})

    keyed = keys.withColumn("shard", F.pmod(F.col("place"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandas(one, _INDEX).coalesce(shards)


class Shard:
    """One shard, ready for probes."""

    def __init__(self, row):
        self.perfect = Perfect(row["sizes"], np.frombuffer(row["bits"], np.uint8))
        self.prints, self.counts, self.keepers = (np.frombuffer(row[c], t) for c, t in (("prints", np.int32), ("counts", np.int32), ("keepers", np.int64)))
        self.shared = {(p, f): (n, k) for p, f, n, k in np.frombuffer(row["shared"], np.int64).reshape(4, -1).T.tolist()}

    def probe(self, place: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold each key, 0 if it isn't indexed; the document that keeps it)."""
        i = self.perfect.index(place.view(np.uint64))
        at = np.maximum(i, 0)
        count, keeper = self.counts[at].astype(np.int64), self.keepers[at].copy()
        count[(i < 0) | ((count != _SHARED) & (self.prints[at] != fingerprint.astype(np.int32)))] = 0
        for j in np.flatnonzero(count == _SHARED):
            count[j], keeper[j] = self.shared.get((int(place[j]), int(fingerprint[j])), (0, 0))
        return count, keeper


class Index:
    """All shards of an index, ready for probes."""

    def __init__(self, rows: list, shards: int):
        self.shards, self.parts = shards, {r["shard"]: Shard(r) for r in rows}

    def probe(self, place: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, keeper = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        shard = place % self.shards  # as pmod
        for s in np.unique(shard).tolist():
            if s in self.parts:
                at = np.flatnonzero(shard == s)
                count[at], keeper[at] = self.parts[s].probe(place[at], fingerprint[at])
        return count, keeper


def _keyed(text: bytes | None, min_chars: int) -> tuple[int, list[int], list[int], list[tuple[int, int]]]:
    """(number of lines, starts, ends and hashes of the lines whose keys are long enough)."""
    n, starts, ends = long_lines(text, min_chars)
    found = [(a, b, hashes(k)) for a, b, k in ((a, b, key_of(text[a:b], min_chars)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)) if k is not None]
    return n, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The text without the lines of the given starts and ends, in order."""
    if not gone:
        return text
    pieces, at = [], 0
    for start, end in gone:
        if start > at:
            pieces.append(text[at : start - 1])
        at = end + 1
    if at <= len(text):
        pieces.append(text[at:])
    return b"\n".join(pieces)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, group_bytes: int = GROUP_BYTES, task_probes: int = TASK_PROBES) -> DataFrame:
    """``docs`` with dedup_text, dedup_lines (before) and dedup_dropped."""
    _rewritten(docs)
    keys = common.checkpointed(counted(docs, min_chars))
    n_keys = keys.count()
    shards = max(1, -(-n_keys // shard_keys))
    index = build(keys, shards)
    if n_keys * KEY_BYTES <= group_bytes:
        return _probe(docs, index.collect(), shards, min_chars, min_docs)
    return _probe_dealt(docs, common.checkpointed(index), shards, min_chars, min_docs, task_probes)


def _rewritten(docs: DataFrame) -> T.StructType:
    return common.added(docs, [T.StructField("dedup_text", T.StringType()), T.StructField("dedup_lines", T.LongType()), T.StructField("dedup_dropped", T.LongType())])


def _emit(batch, texts: list[bytes], n_lines: list[int], n_dropped: list[int]):
    """The batch with its new columns."""
    kept = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*batch.columns, kept, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*batch.schema.names, "dedup_text", "dedup_lines", "dedup_dropped"])


def _probe(docs: DataFrame, rows: list, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(rows)
    at_text, at_id = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches):
        index = Index(held.value, shards)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts = [t or b"" for t in batch.column(at_text).cast(pa.large_binary()).to_pylist()]
                split = [_keyed(t, min_chars) for t in texts]
                count, keeper = index.probe(*(_signed([h[c] for s in split for h in s[3]]) for c in (0, 1)))
                dropped, j = [], 0
                for r, (doc_id, (_, starts, ends, _)) in enumerate(zip(batch.column(at_id).to_pylist(), split, strict=True)):
                    own = slice(j, j + len(starts))
                    j = own.stop
                    out = np.flatnonzero((count[own] >= min_docs) & (keeper[own] != doc_id)) if doc_id is not None else ()
                    texts[r] = without(texts[r], [(starts[i], ends[i]) for i in out])
                    dropped.append(len(out))
                yield _emit(batch, texts, [s[0] for s in split], dropped)

    return common.mapped(docs, run, _rewritten(docs))


def _probe_dealt(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int, task_probes: int) -> DataFrame:
    """The line hashes meet the shards; the hashes that go meet their texts. No task has more than a shard and a batch."""
    copies = F.ceil(F.col("probes") / task_probes).cast("int")
    busy = common.small(index.where(copies > 1).select("shard", copies.alias("copies")))
    dealt = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)))
    probes = line_keys(docs, min_chars, True).withColumn("shard", F.pmod("place", F.lit(shards)))
    probes = probes.join(busy, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("doc_id", "text_hash"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    both = dealt.withColumn("kind", F.lit(0)).unionByName(probes.withColumn("kind", F.lit(1)), True)
    both = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    names = ["place", "fingerprint", "doc_id", "text_hash"]
    at = [both.columns.index(c) for c in ("shard", "kind", *names)]

    def run(batches):
        shard = None
        for batch in batches:
            number, kind = (batch.column(at[c]).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                if kind[a] == 0:
                    shard = Shard(batch.slice(b - 1, 1).to_pylist()[0])  # copies of one shard are the same
                elif b > a:
                    columns = [batch.column(c).slice(a, b - a) for c in at[2:]]
                    place, prints, doc_id = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[:3])
                    count, keeper = shard.probe(place, prints)
                    out = pa.array(np.flatnonzero((count >= min_docs) & (keeper != doc_id)))
                    yield pa.RecordBatch.from_arrays([c.take(out) for c in columns], names=names)

    gone = both.mapInArrow(run, T.StructType([T.StructField(n, T.LongType()) for n in names]))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("place", "fingerprint")).alias("__gone"))  # some of one text's lines
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__gone")
    work = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left").select(*(docs[c] for c in docs.columns), "__gone")
    at_text, at_gone = docs.columns.index("text"), len(docs.columns)

    def finish(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts, n_lines, dropped = [], [], []
                for text, gone in zip(batch.column(at_text).cast(pa.large_binary()).to_pylist(), batch.column(at_gone).to_pylist(), strict=True):
                    n, starts, ends, found = _keyed(text, min_chars)
                    lost = {(x["place"], x["fingerprint"]) for x in gone or ()}
                    out = [(a, b) for a, b, h in zip(starts, ends, zip(*(_signed([h[c] for h in found]).tolist() for c in (0, 1)), strict=True), strict=True) if h in lost] if lost else []
                    texts.append(without(text or b"", out))
                    n_lines.append(n)
                    dropped.append(len(out))
                yield _emit(pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]), texts, n_lines, dropped)

    return common.mapped(work, finish, _rewritten(docs))


def query(spark, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = drop_lines(docs)
    return done.select("doc_id", F.col("dedup_lines").alias("n_lines"), F.col("dedup_dropped").alias("n_dropped"), F.sha2(F.col("dedup_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line,
    regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
keyed AS (
  SELECT doc_id, i, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (o.key IS NOT NULL AND o.keeper <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (o.key IS NULL OR o.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key GROUP BY k.doc_id
"""
