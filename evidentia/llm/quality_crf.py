"""Operator 1, document quality: a linear-chain conditional random field labels every line good or bad.

Each line has features of its own bytes and of the line before and after it. The chain's two states are good and
bad. Labels exist for documents only, so training alternates: lines of good documents are good; lines of bad ones
get the chain's own marginals, pulled to bad where no line of the document looks bad yet. A document's quality is
the mean of its lines' good marginals, weighted by length, on a logistic scale fitted to the training documents.

Memory: texts are worked on together up to a bound of bytes and lines. A longer text goes through in blocks of lines, which
hand on the words seen, the sums and hash of a line that isn't over, and size and hash of a word that isn't; its chain then
needs 24 bytes a line. A text has the same score in blocks as in one piece.

Defined results: a null or empty text is one empty line and gets a score like any other; repeated rows get one
result each; extra columns pass through, and one of a new column's name is an error; with no labels, or of one class only, every score is that class's share
(0.5 without labels). Only the text is read by a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The bounded sample that the chain is fitted on: documents, and characters in each.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000

_CLASSES = {
    "upper": [*range(0x41, 0x5B)],
    "lower": [*range(0x61, 0x7B)],
    "digit": [*range(0x30, 0x3A)],
    "space": [0x20, *range(0x09, 0x0E)],
    "stop": [*b".,;:?'\"-()"],
    "bang": [*b"!"],
    "bar": [*b"|"],
    "symbol": [*b"#$%&*@~^<>{}[]=+\\/_`"],
    "high": [*range(0x80, 0x100)],
}
_TABLES = []
for _bytes in _CLASSES.values():
    _t = np.zeros(256, np.int32)
    _t[_bytes] = 1
    _TABLES.append(_t)


#: Bytes that a line counts for when texts are taken together, and lines from which a chain is cut to segments.
LINE_COST, LONG = 40, 512
_MARKS = np.zeros(256, bool)
_MARKS[[*b"*&%$#@"]] = True


def tally(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, last: int | None = None, known: np.ndarray | None = None, held: tuple | None = None, more: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(counts of each span, each span's hash, what a next block of the same text needs): counts of spans' parts add up.

    ``last``: the hash of the word before the first; ``known``: sorted hashes of the words that the text had before; ``held``:
    (hash, bytes, last byte) of a word that the block before ended in; ``more``: whether another block follows. A word that
    reaches the end of such a block counts in the next one.
    """
    counts = [ends - starts]
    for t in _TABLES:
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(t[data], out=c[1:])
        counts.append(c[ends] - c[starts])
    low = common.lower_ascii(data)
    sums = common.prefix_hash(low)
    ws, we = common.word_spans(data, starts)
    raw, size, tail = common.span_sum(sums, ws, we), we - ws, data[we - 1] if len(ws) else np.zeros(0, np.uint8)
    if held is not None and len(ws) and ws[0] == 0:
        raw[0], size[0] = common.joined(held[0], held[1], raw[0]), size[0] + held[1]
    elif held is not None:  # it ended where the block did
        ws, we, raw, size, tail = np.r_[-1, ws], np.r_[0, we], np.r_[np.uint64(held[0]), raw], np.r_[held[1], size], np.r_[np.uint8(held[2]), tail]
    held = None
    if more and len(ws) and we[-1] == len(data):
        held = (raw[-1], int(size[-1]), tail[-1])
        ws, raw, size, tail = ws[:-1], raw[:-1], size[:-1], tail[:-1]
    h = common.mix(raw)
    a, b = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    a[0] = 0
    same = np.zeros(len(ws), bool)
    same[1:] = h[1:] == h[:-1]
    seen = np.zeros(len(ws), bool)  # a word that the same document had before
    if len(ws):
        same[0] = last is not None and int(h[0]) == last
        key = common.mix(h + np.maximum(np.searchsorted(offsets, ws, "right") - 1, 0).astype(np.uint64))
        _, first = np.unique(key, return_index=True)
        seen[:] = True
        seen[first] = False
        if known is not None:
            at = np.searchsorted(known, h)
            seen |= (known[np.minimum(at, len(known) - 1)] == h) if len(known) else False
            known = np.union1d(known, h)
    for flags in (np.ones(len(ws), bool), size, size <= 2, size >= 12, same, seen, tail == 33, _MARKS[tail], (size == 1) & (tail == 124)):
        c = np.zeros(len(ws) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        counts.append(c[b] - c[a])
    return np.stack(counts, 1).astype(np.int64), common.span_sum(sums, starts, ends), (int(h[-1]) if len(ws) else last, known, held)


def own_features(counts: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A line's own features, from its counts and whether it repeats the line before."""
    length, words = counts[:, 0].astype(np.float64), counts[:, 1 + len(_TABLES)].astype(np.float64)
    classes = [counts[:, 1 + k] / np.maximum(length, 1) for k in range(len(_TABLES))]
    total, short, long, same, seen, bang, mark, bar = (counts[:, 2 + len(_TABLES) + k] / np.maximum(words, 1) for k in range(8))
    own = [np.log1p(length) / 6, length == 0, np.log1p(words) / 4, total / 10, short, long, same, seen, bang, mark, bar, again]
    own += classes + [np.sqrt(c) for c in classes[4:8]] + [c > 0.05 for c in (classes[0], *classes[4:8])] + [classes[0] > 0.5, same > 0.3]
    return np.stack([np.asarray(v, np.float64) for v in own], 1)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of each line, its weight, lines of each document) of whole texts; offsets start at 0."""
    breaks = np.flatnonzero(data == 10)
    doc_of_break = np.searchsorted(offsets, breaks, "right") - 1
    n_lines = 1 + np.bincount(doc_of_break, minlength=len(offsets) - 1)
    # every document begins a line, an empty one or one after a final line break too: build starts by document
    order = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), doc_of_break])
    by = np.lexsort((order, doc))
    starts, doc = order[by], doc[by]
    last = np.r_[doc[1:] != doc[:-1], True]
    ends = np.where(last, offsets[doc + 1], np.r_[starts[1:] - 1, 0])
    counts, hl, _ = tally(data, starts, ends, offsets)
    again = np.zeros(len(starts), bool)
    again[1:] = (hl[1:] == hl[:-1]) & (doc[1:] == doc[:-1]) & (counts[1:, 0] > 0)
    return own_features(counts, again), counts[:, 0] + 1.0, n_lines


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line and its neighbours, its weight, lines of each document) of whole texts."""
    x, weight, n_lines = lines_of(data, offsets)
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    inner = doc[1:] == doc[:-1]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:][inner] = x[:-1][inner]
    after[:-1][inner] = x[1:][inner]
    edge = np.stack([np.r_[True, ~inner], np.r_[~inner, True], np.ones(len(doc), bool)], 1).astype(np.float64)
    return np.concatenate([x, before, after, edge], 1), weight, n_lines


def _emissions(e: np.ndarray) -> np.ndarray:
    em = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], -1)
    return em / em.sum(-1, keepdims=True)


def _segmented(e: np.ndarray, top: np.ndarray, with_back: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """One long chain: (forward share of bad, backward share of bad) of each line, or (P(bad), None).

    The chain is cut to about as many segments as a segment has lines. All segments' products of transfer matrices are
    taken side by side, then the messages between segments, then those inside.
    """
    n = len(e)
    size = int(np.sqrt(n)) + 1
    count = -(-n // size)
    padded = np.zeros(count * size)
    padded[:n] = e
    padded, left = padded.reshape(count, size), n - np.arange(count) * size

    def step(s: int) -> np.ndarray:
        a = top * _emissions(padded[:, s])[:, None, :]
        if s == 0:
            a[0] = np.diag(_emissions(padded[:1, 0])[0])
        a[left <= s] = np.eye(2)
        return a

    product = np.repeat(np.eye(2)[None], count, 0)
    for s in range(size):
        product = product @ step(s)
        product /= product.sum((1, 2), keepdims=True)
    enter, leave, f, b = np.empty((count, 2)), np.empty((count, 2)), np.ones(2), np.ones(2)
    for k in range(count):
        enter[k], leave[count - 1 - k] = f, b
        f, b = f @ product[k], product[count - 1 - k] @ b
        f, b = f / f.sum(), b / b.sum()
    forward, back = np.empty((count, size)), np.empty((count, size)) if with_back else None
    for s in range(size):
        enter = (enter[:, None, :] @ step(s))[:, 0]
        enter /= enter.sum(1, keepdims=True)
        forward[:, s] = enter[:, 1]
    for s in range(size - 1, -1, -1):
        leave /= leave.sum(1, keepdims=True)
        if with_back:
            back[:, s] = leave[:, 1]
        else:
            bad = forward[:, s] * leave[:, 1]
            forward[:, s] = bad / (bad + (1 - forward[:, s]) * leave[:, 0])
        leave = (step(s) @ leave[:, :, None])[:, :, 0]
    return forward.ravel()[:n], back.ravel()[:n] if with_back else None


class Chain:
    """Weights of the field: w for the state bad against good, t for the 2 x 2 transitions."""

    def __init__(self, w: np.ndarray, t: np.ndarray, scale: tuple[float, float], constant: float | None = None):
        self.w, self.t, self.scale, self.constant = w, t, scale, constant

    def top(self) -> np.ndarray:
        return np.exp(self.t - self.t.max())

    def energies(self, x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Each line's score for bad from the own features of it and its neighbours."""
        k = x.shape[1]
        own = x @ np.stack([self.w[:k], self.w[k : 2 * k], self.w[2 * k : 3 * k]], 1)
        first, last = np.cumsum(n_lines) - n_lines, np.cumsum(n_lines) - 1
        e = own[:, 0] + self.w[-1]
        before, after = np.r_[0, own[:-1, 1]], np.r_[own[1:, 2], 0]
        before[first], after[last] = self.w[-3], self.w[-2]
        return e + before + after

    def messages(self, e: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages of each line, each adding up to 1."""
        first = np.cumsum(n_lines) - n_lines
        top, em = self.top(), _emissions(e)
        fwd, back = np.empty_like(em), np.full_like(em, 0.5)
        for d in np.flatnonzero(n_lines > LONG):
            own = slice(first[d], first[d] + n_lines[d])
            f, b = _segmented(e[own], top, True)
            fwd[own], back[own] = np.stack([1 - f, f], 1), np.stack([1 - b, b], 1)
        short = np.flatnonzero(n_lines <= LONG)
        short = short[np.argsort(-n_lines[short], kind="stable")]
        first, size = first[short], n_lines[short]
        most = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(most), "left")  # documents with more than t lines
        for t in range(most):
            i = first[: live[t]] + t
            a = em[i] if t == 0 else em[i] * (fwd[i - 1] @ top)
            fwd[i] = a / a.sum(1, keepdims=True)
        for t in range(most - 2, -1, -1):
            i = first[: live[t + 1]] + t
            b = (em[i + 1] * back[i + 1]) @ top.T
            back[i] = b / b.sum(1, keepdims=True)
        return fwd, back

    def marginals(self, e: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(bad) of each line by forward-backward, and the expected transitions summed to 2 x 2."""
        fwd, back = self.messages(e, n_lines)
        p = fwd * back
        i = np.setdiff1d(np.arange(len(e) - 1), np.cumsum(n_lines) - 1)  # lines with one after them
        after = _emissions(e[i + 1]) * back[i + 1]
        z = ((fwd[i] @ self.top()) * after).sum(1)
        return p[:, 1] / p.sum(1), (fwd[i] / z[:, None]).T @ after * self.top()

    def quality(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, bad lines, lines) of each whole text."""
        if self.constant is not None:
            n_lines = 1 + np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets))
            return np.full(len(n_lines), self.constant), np.zeros(len(n_lines), np.int64), n_lines
        x, weight, n_lines = lines_of(data, offsets)
        bad, _ = self.marginals(self.energies(x, n_lines), n_lines)
        lines = np.r_[0, np.cumsum(bad > 0.5)]
        ends = np.cumsum(n_lines)
        return self.scaled(_good(bad, weight, n_lines)), lines[ends] - lines[ends - n_lines], n_lines

    def scaled(self, good):
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * (good - self.scale[1]), -30, 30)))

    def long_quality(self, data: np.ndarray, block: int = common.CHUNK_BYTES) -> tuple[float, int, int]:
        """The same of one long text, a block of lines at a time."""
        if self.constant is not None:
            return self.constant, 0, 1 + int((data == 10).sum())
        n = 1 + np.count_nonzero(data == 10)
        e, lengths, done = np.zeros(n), np.zeros(n, np.int32 if len(data) < 1 << 31 else np.int64), 0
        at, carried, rest, before, ahead = 0, (None, np.zeros(0, np.uint64), None), None, None, 0.0
        k = (len(self.w) - 3) // 3
        w = np.stack([self.w[:k], self.w[k : 2 * k], self.w[2 * k : 3 * k]], 1)
        while done < n:
            stop = _block_end(data, at, block)
            part = data[at:stop]
            starts = np.r_[0, np.flatnonzero(part == 10) + 1]
            ends = np.r_[starts[1:] - 1, len(part)]
            over = stop == len(data)
            counts, hashes, carried = tally(part, starts, ends, np.array([0, len(part)]), *carried, not over)
            if rest is not None:  # the line that wasn't over
                counts[0] += rest[0]
                hashes[0] = common.joined(rest[1], rest[0][0], hashes[0])
            rest = None if over else (counts[-1], hashes[-1])  # empty after a line break
            cut = len(counts) - (not over)
            again = np.r_[before is not None and hashes[0] == before, hashes[1:] == hashes[:-1]] & (counts[:, 0] > 0)
            if cut:
                own = own_features(counts[:cut], again[:cut]) @ w
                mine = slice(done, done + cut)
                e[mine] += own[:, 0] + self.w[-1] + np.r_[ahead if done else self.w[-3], own[:-1, 1]]
                e[max(0, done - 1) : done + cut - 1] += own[0 if done else 1 :, 2]
                ahead, lengths[mine], done = own[-1, 1], counts[:cut, 0], done + cut
                before = hashes[cut - 1]
            at = stop
        e[-1] += self.w[-2]
        bad, _ = _segmented(e, self.top(), False)
        good = 1 - (bad @ lengths + bad.sum()) / (lengths.sum(dtype=np.int64) + n)
        return float(self.scaled(good)), int((bad > 0.5).sum()), n

    def all_quality(self, data: np.ndarray, offsets: np.ndarray, limit: int = common.CHUNK_BYTES) -> list[np.ndarray]:
        """[score, bad lines, lines] of any number of texts of any length."""
        parts = []
        lines = np.r_[0, np.cumsum([1 + np.count_nonzero(data[a:b] == 10) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.int64)]
        for a, b in common.chunks(offsets + LINE_COST * lines, limit):
            part = data[offsets[a] : offsets[b]]
            if offsets[b] - offsets[a] + LINE_COST * (lines[b] - lines[a]) > limit:
                parts.append(tuple(np.array([x]) for x in self.long_quality(part, limit)))
            else:
                parts.append(self.quality(part, offsets[a : b + 1] - offsets[a]))
        return [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 3


def _block_end(data: np.ndarray, at: int, block: int) -> int:
    """Where a block from ``at`` on ends: after a line, else after a space, within ``block`` bytes and block / LINE_COST lines."""
    part = data[at : at + block]
    breaks = np.flatnonzero(part == 10)
    if len(part) < block and len(breaks) < block // LINE_COST:
        return len(data)
    if len(breaks):
        return at + int(breaks[min(len(breaks), max(1, block // LINE_COST)) - 1]) + 1
    space = np.flatnonzero(common.SPACE[part[1:]])
    return at + (int(space[-1]) + 2 if len(space) else len(part))


def _good(bad: np.ndarray, weight: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    at = np.r_[0, np.cumsum(n_lines)[:-1]]
    return np.add.reduceat((1 - bad) * weight, at) / np.add.reduceat(weight, at)


def fit(rows: list, rounds: int = 4, steps: int = 60) -> Chain:
    """The chain of (text, label) rows, 1 for good; the same for the same rows."""
    labels = np.array([r["label"] for r in rows], np.int64)
    if not len(rows) or labels.min() == labels.max():
        return Chain(np.zeros(1), np.zeros((2, 2)), (1, 0), float(labels.mean()) if len(rows) else 0.5)
    data, offsets = common.text_bytes(pa.array([r["text"] for r in rows], pa.large_string()))
    parts = [line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in common.chunks(offsets)]
    x, weight, n_lines = (np.concatenate(p) for p in zip(*parts, strict=True))
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)), (1, 0))
    doc = np.repeat(np.arange(len(rows)), n_lines)
    bad_doc = labels[doc] == 0
    target = np.where(bad_doc, 0.8, 0.0)
    per = np.where(bad_doc, (~bad_doc).sum() / max(1, bad_doc.sum()), 1.0) ** 0.5
    for round_ in range(rounds):
        m, v = np.zeros(len(chain.w) + 4), np.zeros(len(chain.w) + 4)
        for step in range(1, steps + 1):
            e = x @ chain.w
            p, pair = chain.marginals(e, n_lines)
            # the same chain with lines held to their targets gives the transitions that training wants
            want = chain.marginals(e + 6 * (target - p), n_lines)[1] if step % 10 == 1 else want
            g = np.r_[x.T @ (per * (target - p)) / per.sum() - 1e-4 * chain.w, (want - pair).ravel() / len(x)]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            chain.w, chain.t = chain.w + move[:-4], np.clip(chain.t + move[-4:].reshape(2, 2), -3, 3)
        p, _ = chain.marginals(x @ chain.w, n_lines)
        at = np.r_[0, np.cumsum(n_lines)[:-1]]
        most = np.maximum.reduceat(p, at)[doc]
        target = np.where(bad_doc, np.clip(p / np.maximum(most, 1e-6), 0, 1), 0.0)
    good, y = _good(chain.marginals(x @ chain.w, n_lines)[0], weight, n_lines), labels.astype(float)
    cuts = np.unique(np.quantile(good, np.linspace(0, 1, 400)))
    errors = [((good >= c) != (y == 1)) @ np.where(y == 1, 1 / y.sum(), 1 / (1 - y).sum()) for c in cuts]
    cut = float(np.mean([c for c, e in zip(cuts, errors, strict=True) if e <= min(errors) + 1e-9]))
    spread = max(0.02, float(np.abs(good - cut).mean()))
    slope = 3 / spread
    chain.scale = (slope, cut - np.log(0.7 / 0.3) / slope)  # the best cut of the training documents is at 0.7
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "quality_") -> DataFrame:
    """``docs`` with columns <prefix>score, <prefix>bad_lines and <prefix>lines."""
    names = [f"{prefix}{n}" for n in ("score", "bad_lines", "lines")]
    schema = common.added(docs, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.LongType())])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            data, offsets = common.text_bytes(batch.column(at))
            new = chain.all_quality(data, offsets)
            columns = [*batch.columns, pa.array(new[0], pa.float64()), pa.array(new[1].astype(np.int64)), pa.array(new[2].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return common.mapped(docs, run, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> Chain:
    return fit(common.labelled_sample(docs, labels, "quality", 4, 2, rows, max_chars))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    return scored.select("doc_id", held_out, F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"), F.col("quality_bad_lines").alias("bad_lines"), F.col("quality_lines").alias("n_lines"))
