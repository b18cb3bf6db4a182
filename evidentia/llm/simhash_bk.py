"""Operator 10, near-duplicates by SimHash: BK-trees whose children are keyed by the Hamming distance to the parent.

Fingerprints come from the hashes of 4-word shingles of whole texts. Documents of one fingerprint are one node, so
copies cost one row. Fingerprints at most ``RADIUS`` bits apart agree on all bits of some choice of blocks (by the
pigeonhole principle), so every such choice is a table of shards by its bits, and each shard has a BK-tree that its
members search, following only edges within the radius of their distance. More fingerprints get narrower shards. A
shard of over ``TREE_KEYS`` keys is cut to trees of about so many, and each is searched by the members of those before
it too, one tree's members at a time: a task holds one tree and one such block of probes. It gives one edge from each
of them to the smallest node it is linked with there, never all pairs; alternating star contraction joins these.

Memory: fingerprints are summed in blocks of ``common.CHUNK_BYTES`` of text, however long the text.

Defined results: a null, empty or white text has fingerprint zero and is linked like any other; repeated rows get one
result each; texts under one doc_id are one node; rows of null doc_id have a fingerprint and a null component and link
nothing; extra columns pass through.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE, RADIUS, SEED = 4, 4, 42
TREE_KEYS = 20_000
#: Keys of random fingerprints that a shard holds at most; beyond, the blocks are cut finer.
SHARD_MEAN = 64
#: Bytes of short texts whose shingles' bits are in memory at once.
PRINT_BYTES = 1 << 18
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _long_fingerprint(raw: bytes, shingle: int) -> int:
    ones, n, words, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(raw):
        stop = at + common.CHUNK_BYTES
        stop = m.start() if stop < len(raw) and (m := _WHITE.search(raw, stop)) else len(raw)
        words = words[max(0, len(words) - shingle + 1) :] + raw[at:stop].lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
        ones, n, at = ones + _ones(hashes).sum(0), n + len(hashes), stop
    if words and not n:
        ones, n = _ones([xxhash.xxh64_intdigest(b" ".join(words), SEED)])[0], 1
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each whole text."""
    raw, hashes, sizes, long = data.tobytes(), [], [], {}
    digest, base = xxhash.xxh64_intdigest, offsets[0]
    for k, (a, b) in enumerate(zip(offsets[:-1] - base, offsets[1:] - base, strict=True)):
        if b - a > common.CHUNK_BYTES:
            long[k] = _long_fingerprint(raw[a:b], shingle)
            sizes.append(0)
            continue
        words = raw[a:b].lower().split()
        n = max(1, len(words) - shingle + 1) if words else 0
        sizes.append(n)
        hashes += [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)]
    sizes = np.array(sizes, np.int64)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        ones = np.add.reduceat(_ones(hashes), (np.cumsum(sizes) - sizes)[full], 0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > sizes[full, None], axis=1).view(">u8").ravel()
    for k, h in long.items():
        out[k] = h
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(at))
            parts = [fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1], shingle) for a, b in common.chunks(offsets, PRINT_BYTES)]
            out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], names=[*batch.schema.names, name])

    return common.mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


class Tree:
    """A BK-tree of distinct fingerprints, built a level at a time: the first key of a group is its node."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.children = keys, {}
        todo = [(None, 0, np.arange(len(keys)))] if len(keys) else []
        while todo:
            parent, edge, group = todo.pop()
            node, rest = int(group[0]), group[1:]
            if parent is not None:
                self.children.setdefault(parent, []).append((edge, node))
            if len(rest):
                d = np.bitwise_count(keys[rest] ^ keys[node])
                order = np.argsort(d, kind="stable")
                rest, d = rest[order], d[order]
                cuts = np.flatnonzero(np.diff(d)) + 1
                for part, first in zip(np.split(rest, cuts), np.r_[0, cuts], strict=True):
                    todo.append((node, int(d[first]), part))

    def search(self, probes: np.ndarray, radius: int):
        """(node, numbers of the probes within the radius of it), for every node that has any."""
        todo = [(0, np.arange(len(probes)))] if len(self.keys) and len(probes) else []
        while todo:
            node, here = todo.pop()
            d = np.bitwise_count(probes[here] ^ self.keys[node]).astype(np.int16)
            if len(near := here[d <= radius]):
                yield node, near
            for edge, child in self.children.get(node, ()):
                on = here[np.abs(d - edge) <= radius]
                if len(on):
                    todo.append((child, on))


def linked(keys: np.ndarray, in_tree: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node linked with it) of one tree's members and its probes: all others, or itself without any."""
    order = np.argsort(~in_tree, kind="stable")
    keys, nodes, members = keys[order], nodes[order], int(in_tree.sum())
    if not members or len(keys) < 2:
        return nodes[:0], nodes[:0]
    tree, above, first = Tree(keys[:members]), np.arange(len(keys)), members if members < len(keys) else 0

    def roots(of: np.ndarray) -> np.ndarray:
        while True:
            up = above[of]
            if (up == of).all():
                return of
            of = up

    for node, near in tree.search(keys[first:], radius):
        near = np.append(near + first, node)
        found = above[near]
        if (found != found[0]).any() or above[found[0]] != found[0]:
            found = roots(near)
            above[found] = found.min()
            above[near] = found.min()
    top = roots(np.arange(len(keys)))
    low = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(low, top, nodes)
    root = low[top]
    moved = root != nodes
    return nodes[moved], root[moved]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """How many blocks to cut 64 bits into: the fewest with shards of at most SHARD_MEAN keys on average."""
    m = radius + 1
    while m < 16 and n / 2.0 ** ((m - radius) * 64 // m) > SHARD_MEAN:
        m += 1
    return m


def shard_keys(m: int, radius: int = RADIUS) -> list:
    """A column for each choice of m - radius blocks: the fingerprint's bits there, under the choice's number."""
    edges = [64 * i // m for i in range(m + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(m), m - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(k).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(signed)).alias("bits")))
    return out


def links(nodes: DataFrame, n: int, radius: int = RADIUS, tree_keys: int = TREE_KEYS) -> DataFrame:
    """Edges (src, dst), dst < src, that connect all nodes (fingerprint, node) within the radius of each other."""
    sharded = nodes.select("fingerprint", "node", F.explode(F.array(*shard_keys(blocks_for(n, radius), radius))).alias("s")).select("fingerprint", "node", "s.choice", "s.bits")
    large = sharded.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_keys).withColumn("trees", F.ceil(F.col("n") / tree_keys).cast("int")).drop("n")
    cut = sharded.join(large, ["choice", "bits"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("trees")).cast("int"))
    # a member of tree ``own`` is there with every tree: in its own, or a probe of it
    other = F.sequence(F.lit(0), F.col("trees") - 1)
    cut = cut.withColumn("pair", F.explode(F.transform(other, lambda x: F.struct(F.greatest(x, F.col("own")).alias("tree"), F.least(x, F.col("own")).alias("block")))))
    schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(7)]
            change = np.flatnonzero(np.any([np.diff(columns[c]) != 0 for c in range(4)], axis=0)) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, batch.num_rows], strict=True):
                part = [c[a:b] for c in columns]
                if held and any(held[0][c][0] != part[c][0] for c in range(4)):
                    yield from close(held)
                    held = []
                held.append(part)
        if held:
            yield from close(held)

    def close(parts):
        _, _, tree, _, own, keys, node = (np.concatenate(c) for c in zip(*parts, strict=True))
        if len(keys) > 1:
            src, dst = linked(keys.astype(np.int64).view(np.uint64), own == tree, node.astype(np.int64), radius)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    group = ["choice", "bits", "tree", "block"]
    ordered = cut.select("choice", "bits", "pair.tree", "pair.block", "own", "fingerprint", "node").repartition(*group).sortWithinPartitions(*group, "own", "fingerprint")
    return ordered.mapInArrow(run, schema).distinct()


#: Rows of a few numbers that one file of a checkpoint has at least, where there are more partitions.
FILE_ROWS = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (src, dst) reaches, by alternating stars.

    Every round ends in a checkpoint in the shared folder; a node's neighbours only ever meet in a grouped minimum.
    """
    edges, before = common.checkpointed(edges.where("src <> dst")), None
    files = edges.count() // FILE_ROWS + 1
    while True:
        both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        lower = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(lower, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(lower.select("src", F.col("m").alias("dst")))
        edges = common.checkpointed(small.where("src <> dst").distinct().coalesce(files))  # rounds never add edges
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        before, files = now, now[0] // FILE_ROWS + 1


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tree_keys: int = TREE_KEYS) -> DataFrame:
    """(doc_id, fingerprint as a long, component_id), one row for each row of ``docs``."""
    marked = common.checkpointed(with_fingerprint(docs.select(F.col("doc_id").cast("long"), "text"), shingle=shingle).select("doc_id", "fingerprint"))
    nodes = common.checkpointed(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"))
    # texts under one doc_id are one node even if their fingerprints are far apart
    same = marked.where("doc_id IS NOT NULL").join(nodes, "fingerprint").where("doc_id <> node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    shared = marked.groupBy("doc_id").agg(F.min("fingerprint").alias("f"), F.max("fingerprint").alias("g")).where("doc_id IS NOT NULL AND f <> g").select(F.col("doc_id").alias("src"))
    same = same.join(shared, "src", "left_semi")
    found = components(links(nodes, nodes.count(), radius, tree_keys).unionByName(same))
    ids = nodes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    out = marked.join(ids, "fingerprint", "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
