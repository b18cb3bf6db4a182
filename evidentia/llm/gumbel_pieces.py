"""Operator 9, SentencePiece encoding and decoding: Gumbel top-k segmentations without replacement.

A vocabulary's pieces span a lattice over a text's bytes (a space is the word mark, one stands before each text;
characters without a piece go by byte pieces). A piece's log-probability is that of a Zipf law over the vocabulary's
own order. The k segmentations of largest Gumbel-perturbed log-probability are a sample without replacement; they
are found by a perturbed A* search from the root down: a node of the search is a prefix and what was already taken
after it, its key the largest perturbed log-probability below it, drawn given the bound from its parent. Taking the
best node fixes one other edge there, and the rest of the path keeps that key, so it is drawn edge by edge from the
lattice's backward sums. Each sample carries its perturbed value and the logarithm of its inclusion probability given
the largest value left, which is what estimators over such samples divide by.

Randomness is a hash of seed, row key, draw and byte position: results don't depend on batches or partitions. Equal
words of a task share one lattice, which is kept for its next batches up to a bound of nodes, and drawing runs over all
words of a batch at once. Texts are whole; a text's lattice is cut only at places that no piece of the vocabulary spans.

Defined results: a null or empty text has one segmentation, of no pieces, with inclusion 1; a text with fewer than k
segmentations gives all of them; rows of one key and text get equal samples; null keys count as key 0; extra columns
pass through the operator. Decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Where the vocabulary is; any SentencePiece model file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED, ZIPF = 2, 17, 10.0
#: Bytes of text whose lattices are in memory at once; a longer text is alone.
CHUNK_BYTES = 1 << 19
#: Nodes that a task keeps from one batch to the next, some 150 bytes each, and bits of the table that finds them.
KEPT_NODES, SLOTS = 300_000, 19
_MARK = "▁".encode()
_NONE = np.float64(-np.inf)


class Vocabulary:
    """Pieces as bytes, their log-probabilities, and a hash table of them and of their prefixes."""

    def __init__(self, pieces: list[tuple[bytes, int, float]], byte_ids: list[int]):
        """pieces: (bytes, id, score) of each ordinary piece; byte_ids: the ids of the 256 byte pieces."""
        ranked = sorted(pieces, key=lambda p: (-p[2], p[1]))
        n = max([*(p[1] for p in pieces), *byte_ids]) + 1
        mass = np.full(n, np.inf)
        for rank, (_, i, _) in enumerate(ranked):
            mass[i] = rank + ZIPF
        mass[byte_ids] = len(ranked) + ZIPF
        self.logp = -np.log(mass) - np.log((1 / mass).sum())
        self.bytes = [b""] * n
        for text, i, _ in pieces:
            self.bytes[i] = text
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self.byte_ids = np.array(byte_ids, np.int64)
        self.lengths = np.array([len(t) for t in self.bytes])
        self.pool, self.places = np.frombuffer(b"".join(self.bytes), np.uint8), np.r_[0, np.cumsum(self.lengths)]
        texts = {text: i for text, i, _ in reversed(ranked)}
        prefixes = {t[:k] for t in texts for k in range(1, len(t))}
        keys = sorted(texts.keys() | prefixes)
        self.longest = max(map(len, keys))
        data, offsets = np.frombuffer(b"".join(keys), np.uint8), np.r_[0, np.cumsum([len(k) for k in keys])]
        h = common.span_hash(common.prefix_hash(data), offsets[:-1], offsets[1:])
        order = np.argsort(h)
        self.hashes = h[order]
        self.ids = np.array([texts.get(k, -1) for k in keys], np.int32)[order]
        self.more = np.array([k in prefixes for k in keys])[order]
        self.shift = np.uint64(64 - 20)
        self.slots = np.full(1 << 20, -1, np.int32)
        spot = (self.hashes >> self.shift).astype(np.int64)
        self.slots[spot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        self.crowded = np.bincount(spot, minlength=1 << 20) > 1
        # where a text's lattice may be cut: before a run of spaces, and around line breaks
        self.cut_space = not any(b" " in t.lstrip(b" ") for t in texts)
        self.cut_break = not any(b"\n" in t and len(t) > 1 for t in texts)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The table's row of each hash, -1 if none."""
        spot = (h >> self.shift).astype(np.int64)
        row = self.slots[spot].astype(np.int64)
        hit = (row >= 0) & (self.hashes[row] == h)
        again = np.flatnonzero(~hit & self.crowded[spot])
        row[~hit] = -1
        if len(again):
            at = np.minimum(np.searchsorted(self.hashes, h[again]), len(self.hashes) - 1)
            row[again] = np.where(self.hashes[at] == h[again], at, -1)
        return row


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append((sp.id_to_piece(i).encode().replace(_MARK, b" "), i, sp.get_score(i)))
    if len(byte_ids) < 256:
        raise ValueError("the vocabulary has no byte pieces, so it can't encode every text")
    return Vocabulary(pieces, [byte_ids[b] for b in range(256)])


class Lattice:
    """The lattices of all words that a task has met; a node is what is left of a word from some byte on.

    Backward sums depend on nothing but that rest, so equal ends of words are one node: it is built once and kept for
    the task's next batches. Node 0 is a word's end. With more than ``most`` nodes a new batch starts anew.
    """

    NODE, EDGE = ("beta", "edge_from", "edge_to"), ("p", "log", "piece", "size", "start", "end")
    TYPES = {"beta": np.float64, "p": np.float64, "log": np.float64, "size": np.int32, "start": np.int32}

    def __init__(self, v: Vocabulary, most: int = KEPT_NODES):
        self.v, self.most = v, most
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int64)
        self.nodes, self.edges = 1, 0
        for name in (*self.NODE, *self.EDGE):
            setattr(self, name, np.zeros(1 if name in self.NODE else 0, self.TYPES.get(name, np.int64)))

    def words(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The node of each word [a, b) of ``data``; the words follow one another."""
        if self.nodes > self.most:
            self.clear()
        out, k = np.empty(len(a), np.int64), 0
        while k < len(a):  # a long text's words some at a time
            n = max(k + 1, int(np.searchsorted(b, a[k] + CHUNK_BYTES, "right")))
            out[k:n] = self._number(data[a[k] : b[n - 1]], a[k:n] - a[k], b[k:n] - a[k])
            k = n
        return out

    def _number(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(data)
        place, end = np.arange(n), np.repeat(b, b - a)
        h = common.span_hash(common.prefix_hash(data), place, end) ^ (end - place).astype(np.uint64)
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        keys, nodes = self.table
        node = nodes[slot]
        new = np.flatnonzero((keys[slot] != h) | (node < 0))
        if len(new):
            # of equal new ends one is taken; two that share a slot may both be, which costs a node and no more
            nodes[slot[new]] = new
            first = nodes[slot[new]]
            same = h[first] == h[new]
            own = new[(first == new) | ~same]
            keys[slot[own]] = h[own]
            left = (end - place)[own]
            own = own[np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")]
            number = self.nodes + np.arange(len(own))
            node[own] = number
            node[new[same]] = node[first[same]]
            nodes[slot[own]] = number
            keys[slot[own]] = h[own]
            self._build(data, own, end[own] - own, np.r_[node, 0], end)
        return node[a]

    def _build(self, data: np.ndarray, own: np.ndarray, left: np.ndarray, node: np.ndarray, end: np.ndarray) -> None:
        """Edges and backward sums of the new nodes at bytes ``own``, shortest rests first."""
        v, n, m = self.v, len(data), len(own)
        sums = common.prefix_hash(data)
        lead = (data & 0xC0) != 0x80
        rank, alive, size, ranks, spans, ids = np.arange(m)[lead[own]], own[lead[own]], 1, [], [], []
        leads = np.flatnonzero(lead)
        width = np.minimum(np.r_[leads, n][np.searchsorted(leads, alive, "right")] - alive, left[rank])  # bytes of the character
        wide = np.zeros(m, np.int64)
        wide[rank] = width
        poor = np.ones(m, bool)  # no piece for the character that begins here, or none begins
        # the literal word mark may not be read as a piece: no piece holds its bytes, as marks became spaces
        while len(alive) and size <= v.longest:
            more = left[rank] >= size
            alive, rank = alive[more], rank[more]
            row = v.find(common.span_hash(sums, alive, alive + size))
            known = row >= 0
            alive, rank, row = alive[known], rank[known], row[known]
            piece = v.ids[row]
            whole = piece >= 0
            ranks.append(rank[whole])
            spans.append(size)
            ids.append(piece[whole].astype(np.int64))
            poor[rank[whole][wide[rank[whole]] == size]] = False
            more = v.more[row]
            alive, rank = alive[more], rank[more]
            size += 1
        loose = np.flatnonzero(poor)
        ranks.append(loose)
        spans.append(1)
        ids.append(v.byte_ids[data[own[loose]]])
        free = np.zeros(m + 1, np.int64)
        for r in ranks:
            free[r + 1] += 1  # a byte starts one edge of a size at most
        free = np.cumsum(free)
        low, high = free[:-1].copy(), free[1:].copy()
        f, s, piece = (np.empty(int(free[-1]), t) for t in (np.int64, np.int32, np.int64))
        for r, size, id_ in zip(ranks[::-1], spans[::-1], ids[::-1], strict=True):  # longest first: the likeliest
            slot = free[r]
            free[r] += 1
            f[slot], s[slot], piece[slot] = r, size, id_
        stop = own[f] + s
        target = np.where(stop == end[own[f]], 0, node[stop])
        weight = v.logp[piece]
        self._grow(m, len(f))
        beta = self.beta
        levels = np.flatnonzero(np.r_[True, np.diff(left) != 0, True])
        p = np.empty(len(f))
        for x, y in zip(levels[:-1], levels[1:], strict=True):
            i, j = low[x], high[y - 1]
            w = weight[i:j] + beta[target[i:j]]
            cuts, sizes = low[x:y] - i, high[x:y] - low[x:y]
            top = np.maximum.reduceat(w, cuts)
            top[~np.isfinite(top)] = 0
            e = np.exp(w - np.repeat(top, sizes))
            total = np.add.reduceat(e, cuts)
            with np.errstate(divide="ignore"):
                beta[self.nodes + x : self.nodes + y] = top + np.log(total)
            p[i:j] = e / np.repeat(np.where(total > 0, total, 1), sizes)
        nodes, edges = slice(self.nodes, self.nodes + m), slice(self.edges, self.edges + len(f))
        self.edge_from[nodes], self.edge_to[nodes] = low + self.edges, high + self.edges
        self.p[edges], self.piece[edges], self.size[edges], self.end[edges] = p, piece, s, target
        self.start[edges] = f + self.nodes
        with np.errstate(invalid="ignore"):
            self.log[edges] = weight + beta[target] - beta[f + self.nodes]  # log-probabilities given the node
        self.nodes, self.edges = nodes.stop, edges.stop

    def _grow(self, nodes: int, edges: int) -> None:
        for names, need in ((self.NODE, self.nodes + nodes), (self.EDGE, self.edges + edges)):
            for name in names:
                old = getattr(self, name)
                if need > len(old):
                    grown = np.empty(max(need, len(old) + len(old) // 2), old.dtype)
                    grown[: len(old)] = old
                    setattr(self, name, grown)

    def others(self, edges):
        """Log-probabilities of all other edges of their nodes."""
        with np.errstate(divide="ignore"):
            return np.log1p(-np.minimum(self.p[edges], 1.0))


def uniform(key: np.ndarray, draw: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but the arguments."""
    with np.errstate(over="ignore"):
        h = common.mix(key + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(draw * 0xA0761D6478BD642F & (1 << 64) - 1))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def draw_paths(lattice: Lattice, node: np.ndarray, key: np.ndarray, place: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges of each start's path to its word's end, their byte places in the document, edges of each): drawn from the lattice's posterior."""
    node, place, live, steps, count = node.copy(), place.copy(), np.flatnonzero(node), [], np.zeros(len(node), np.int64)
    while len(live):
        edge, at = lattice.edge_from[node[live]], place[live]
        last_edge = lattice.edge_to[node[live]] - 1
        u = uniform(key[live], draw, at)
        p = lattice.p[edge]
        on = np.flatnonzero(p < u)
        last_edge = last_edge[on]
        u, p, to = u[on], p[on], edge[on]
        while len(on):
            more = to < last_edge
            on, u, p, to, last_edge = (x[more] for x in (on, u, p, to, last_edge))
            u, to = u - p, to + 1
            edge[on] = to
            p = lattice.p[to]
            more = p < u
            on, u, p, to, last_edge = (x[more] for x in (on, u, p, to, last_edge))
        steps.append((live, edge, at))
        count[live] += 1
        node[live] = lattice.end[edge]
        place[live] = at + lattice.size[edge]
        live = live[node[live] != 0]
    first = np.cumsum(count) - count
    out, places = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
    for t, (who, edge, at) in enumerate(steps):
        slot = first[who] + t
        out[slot], places[slot] = edge, at
    return out, places, count


def _bounded_gumbel(location: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Gumbels of these locations, given that none is above the bound."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = location - np.log(np.exp(location - bound) - np.log(u))
    return np.where(np.isfinite(location), np.minimum(out, bound), _NONE)


def sample(v: Vocabulary, texts: list[bytes], keys: np.ndarray, k: int = SAMPLES, lattice: Lattice | None = None) -> list[list[tuple]]:
    """For each text its samples (piece ids, log-probability, log-posterior, perturbed value, log-inclusion), best first.

    ``lattice``: the words met so far, which is added to.
    """
    lattice = Lattice(v) if lattice is None else lattice
    full = [i for i, t in enumerate(texts) if t]
    out: list[list[tuple]] = [[(np.zeros(0, np.int64), 0.0, 0.0, 0.0, 0.0)] if not t else [] for t in texts]
    if not full:
        return out
    keys = keys[full]
    marked = [b" " + texts[i] for i in full]
    data = np.frombuffer(b"".join(marked), np.uint8)
    ends = np.cumsum([len(t) for t in marked])
    begins = ends - np.array([len(t) for t in marked])
    cut = np.zeros(len(data), bool)
    cut[begins] = True
    if v.cut_space:
        space = data == 0x20
        cut[1:] |= space[1:] & ~space[:-1]
    if v.cut_break:
        line = data == 0x0A
        cut |= line
        cut[1:] |= line[:-1]
    a = np.flatnonzero(cut)
    b = np.r_[a[1:], len(data)]
    nodes = lattice.words(data, a, b)
    doc_of = np.searchsorted(begins, a, "right") - 1
    first_word = np.searchsorted(a, np.r_[begins, len(data)])
    word_place, word_keys = a - begins[doc_of], keys[doc_of]
    edges, places, count = draw_paths(lattice, nodes, word_keys, word_place, 1)
    edge_word = np.repeat(np.arange(len(a)), count)
    path_first = np.r_[0, np.cumsum(count)][first_word]
    logs = lattice.log[edges]
    tops = -np.log(-np.log(uniform(keys, 0, np.zeros(len(full)))))
    if k > 1:  # what leaves each first path, drawn for all texts at once
        doc = doc_of[edge_word]
        befores = np.empty(len(edges))
        for d in range(len(full)):
            own = slice(path_first[d], path_first[d + 1])
            np.subtract(np.cumsum(logs[own]), logs[own], out=befores[own])
        leaving = _bounded_gumbel(befores + lattice.others(edges), tops[doc], uniform(keys[doc], 2, places))
    states = []
    for d in range(len(full)):
        own = slice(path_first[d], path_first[d + 1])
        first = [_front(leaving[own], befores[own])] if k > 1 else []
        states.append([first, [(edges[own], edge_word[own], logs[own], float(tops[d]), places[own])]])
    for s in range(1, k):
        todo = []
        for d, (fronts, samples) in enumerate(states):
            if len(samples) != s:
                continue  # no segmentation was left
            owner = max(range(len(fronts)), key=lambda j: fronts[j]["best"])
            front = fronts[owner]
            if front["best"] == _NONE:
                continue
            i = front["at"]
            path, words, _, _, where = samples[owner]
            chosen = path[i]
            node = lattice.start[chosen]
            low, high = int(lattice.edge_from[node]), int(lattice.edge_to[node])
            taken = front["taken"].setdefault(i, [chosen])
            p = lattice.p[low:high].copy()
            p[[t - low for t in taken]] = 0
            place = where[i]
            c = np.cumsum(p)
            u = float(uniform(keys[d : d + 1], 4 * s + 3, np.array([place]))[0])
            other = low + min(int(np.searchsorted(c, u * c[-1], "right")), len(p) - 1)
            while p[other - low] == 0:
                other -= 1
            value = front["best"]
            taken.append(other)
            rest = 1 - lattice.p[taken].sum()
            more = front["before"][i] + (np.log(rest) if rest > 1e-12 else _NONE)
            u = uniform(keys[d : d + 1], 4 * s + 4, np.array([place]))
            front["g"][i] = _bounded_gumbel(np.array([more]), value, u)[0] if len(taken) < (lattice.p[low:high] > 0).sum() else _NONE
            front["at"] = int(front["g"].argmax())
            front["best"] = front["g"][front["at"]]
            todo.append((d, owner, i, other, value))
        if not todo:
            break
        whose, start, at = [], [], []
        for d, owner, i, other, _ in todo:
            _, words, _, _, where = states[d][1][owner]
            rest = np.arange(words[i], first_word[d + 1])
            begin, place = nodes[rest], word_place[rest]
            begin[0], place[0] = lattice.end[other], where[i] + lattice.size[other]
            whose.append(rest)
            start.append(begin)
            at.append(place)
        rest = np.concatenate(whose)
        new, new_places, many = draw_paths(lattice, np.concatenate(start), word_keys[rest], np.concatenate(at), s + 1)
        new_words, new_logs = np.repeat(rest, many), lattice.log[new]
        new_first = np.r_[0, np.cumsum(many)][np.r_[0, np.cumsum([len(w) for w in whose])]]
        for j, (d, owner, i, other, value) in enumerate(todo):
            fronts, samples = states[d]
            path, words, log, _, where = samples[owner]
            own = slice(new_first[j], new_first[j + 1])
            path = np.concatenate([path[:i], [other], new[own]])
            words = np.concatenate([words[: i + 1], new_words[own]])
            where = np.concatenate([where[: i + 1], new_places[own]])
            log = np.concatenate([log[:i], [lattice.log[other]], new_logs[own]])
            if s + 1 < k:
                fronts.append(_frontier(lattice, path, where, log, keys[d], value, i + 1, 4 * s + 2))
            samples.append((path, words, log, value, where))
    for d, (_, samples) in enumerate(states):
        posteriors = [float(log.sum()) for _, _, log, _, _ in samples]
        # all that wasn't taken is below the last sample's value, so its largest value is one bounded draw
        rest = 1 - sum(np.exp(p) for p in posteriors)
        u = uniform(keys[d : d + 1], 4 * k + 5, np.zeros(1))
        left = float(_bounded_gumbel(np.array([np.log(rest)]), samples[-1][3], u)[0]) if rest > 1e-12 and len(samples) == k else _NONE
        for (path, _, _, value, _), posterior in zip(samples, posteriors, strict=True):
            ids = lattice.piece[path]
            out[full[d]].append((ids, float(v.logp[ids].sum()), posterior, value, log_inclusion(posterior, left)))
    return out


def _front(g: np.ndarray, before: np.ndarray) -> dict:
    at = int(g.argmax()) if len(g) else 0
    return {"g": g, "before": before, "at": at, "best": g[at] if len(g) else _NONE, "taken": {}}


def _frontier(lattice, path, places, logs, key, bound, begin, draw) -> dict:
    """The search's nodes along a path from edge ``begin`` on: everything that leaves it there."""
    g = np.full(len(path), _NONE)
    mine = path[begin:]
    before = np.cumsum(logs) - logs
    u = uniform(np.full(len(mine), key, np.uint64), draw, places[begin:])
    g[begin:] = _bounded_gumbel(before[begin:] + lattice.others(mine), bound, u)
    return _front(g, before)


def log_inclusion(posterior: float, threshold: float) -> float:
    """The logarithm of the chance that a segmentation's perturbed value is above the threshold."""
    if threshold == _NONE:
        return 0.0
    x = posterior - threshold
    if x < -30:
        return x
    return float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of piece ids: the pieces' bytes without the mark before the text."""
    ids = np.asarray(ids, np.int64)
    size = v.lengths[ids]
    ends = np.cumsum(size)
    shift = np.repeat(v.places[ids] - ends + size, size)
    return v.pool[shift + np.arange(len(shift))].tobytes()[1:]


def row_keys(ids: list, seed: int = SEED) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mix(np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))


def encode(docs: DataFrame, vocabulary: Vocabulary, k: int = SAMPLES, key: str = "doc_id", text: str = "text", seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """The other columns of ``docs`` and sample, n_pieces, log_prob, log_posterior, perturbed, log_inclusion, ids_sha256, decodes and the piece ids.

    ids_sha256 is of the ids as little-endian 32-bit numbers; decodes says whether decoding them gives the text. A column
    of ``docs`` that has one of these names is an error.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [T.StructField("sample", T.IntegerType()), T.StructField("n_pieces", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("log_prob", "log_posterior", "perturbed", "log_inclusion")), T.StructField("ids_sha256", T.StringType()), T.StructField("decodes", T.BooleanType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = common.added(docs, fields, (text,))
    at_text, at_key, at_kept = docs.columns.index(text), docs.columns.index(key), [docs.columns.index(f.name) for f in kept]

    def run(batches):
        v = held.value
        lattice = Lattice(v)
        types = [pa.int32(), pa.int64(), *[pa.float64()] * 4, pa.string(), pa.bool_()]
        for whole in batches:
            _, offsets = common.text_bytes(whole.column(at_text))
            for a, b in common.chunks(offsets, CHUNK_BYTES):
                batch = whole.slice(a, b - a)
                texts = [t or b"" for t in batch.column(at_text).cast(pa.large_binary()).to_pylist()]
                found = sample(v, texts, row_keys(batch.column(at_key).to_pylist(), seed), k, lattice)
                rows, columns, pieces = [], [[] for _ in types], []
                for r, (t, samples) in enumerate(zip(texts, found, strict=True)):
                    for s, (ids, prob, posterior, value, inclusion) in enumerate(samples):
                        rows.append(r)
                        pieces.append(ids.astype("<i4"))
                        new = (s + 1, len(ids), prob, posterior, value, inclusion, hashlib.sha256(pieces[-1].tobytes()).hexdigest(), decode(v, ids) == t)
                        for c, x in zip(columns, new, strict=True):
                            c.append(x)
                taken = batch.take(pa.array(rows, pa.int64()))
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                if with_ids:
                    ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pieces) if pieces else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in at_kept), *arrays], names=schema.names)

    return common.mapped(docs, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, load(), with_ids=False)
