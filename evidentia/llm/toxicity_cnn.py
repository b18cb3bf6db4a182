"""Operator 4, toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed embeddings of the whole word and of its first bytes, so that a new ending of a
known stem is known. Filters one, two and three words wide run over the whole text and are max-pooled; a logistic
layer reads the maxima. A cut is calibrated for each language on documents that the weights weren't fitted on, the
language being read off the text's own function words, and the score is shifted so that this cut is 0.7.

Memory: texts are worked on together up to ``BLOCK`` bytes. A longer text goes through in blocks cut between words, which hand on
its last two words and the filters' running maxima, so its score is that of the whole text; a word longer than a block
is held whole, at some 40 bytes a byte.

Defined results: a null or empty text is scored as a text without words; repeated rows get one result each; extra
columns pass through, and one of a new column's name is an error; without labels, or with one class only, each score is that class's share (0.5 without labels).
Only the text is read by a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The bounded sample that the network is fitted on: documents, and characters in each.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 12
#: Bytes of a word's start that have embeddings of their own.
STEMS = (3, 4, 5)
_WIDE = max(WIDTHS)
#: Bytes of text that are worked on at once.
BLOCK = 1 << 20

# Common function words of each language.
FUNCTION_WORDS = {
    "de": ["der", "die", "das", "und", "den", "dem", "ist", "nicht", "mit", "sich", "auf", "für", "ein", "eine", "zu", "von"],
    "en": ["the", "of", "and", "to", "that", "is", "was", "for", "with", "it", "are", "this", "be", "by"],
    "es": ["el", "los", "las", "que", "una", "por", "con", "para", "del", "su", "al", "lo", "se", "no", "y"],
    "fr": ["le", "les", "des", "et", "une", "est", "dans", "qui", "par", "pour", "du", "pas", "sur", "au", "elle"],
}


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = common.text_bytes(pa.array(words, pa.large_string()))
    return common.span_hash(common.prefix_hash(data), offsets[:-1], offsets[1:])


_KNOWN = [_hash_words(w) for w in FUNCTION_WORDS.values()]
LANGUAGES = len(_KNOWN)


def language_of(seen: np.ndarray) -> np.ndarray:
    """The language of most function words, by counts of each; LANGUAGES: none."""
    return np.where(seen.max(1, initial=0) > 0, seen.argmax(1), LANGUAGES)


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket ids of each word, words of each document, its function words of each language)."""
    low = common.lower_ascii(data)
    ws, we = common.word_spans(low, offsets, common.ALNUM)
    sums = common.prefix_hash(low)
    whole = common.span_hash(sums, ws, we)
    ids = [whole % np.uint64(BUCKETS)]
    for k in STEMS:
        ids.append((common.span_hash(sums, ws, np.minimum(we, ws + k)) + np.uint64(k)) % np.uint64(BUCKETS))
    n_words = np.diff(np.searchsorted(ws, offsets))
    doc = np.repeat(np.arange(len(n_words)), n_words)
    seen = np.stack([np.bincount(doc[np.isin(whole, k)], minlength=len(n_words)) for k in _KNOWN], 1)
    return np.stack(ids, 1).astype(np.int32), n_words, seen


class Net:
    def __init__(self, constant: float | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = FILTERS * len(WIDTHS)
        self.constant = constant
        self.e = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.e[BUCKETS] = 0  # the padding
        self.mask = np.concatenate([np.repeat(np.r_[np.ones(w), np.zeros(_WIDE - w)], DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
        self.w = (rng.normal(0, 0.3, (_WIDE * DIM, f)) * self.mask).astype(np.float32)
        self.b, self.v, self.c = np.zeros(f, np.float32), rng.normal(0, 0.3, f).astype(np.float32), np.float32(0)
        self.cuts = np.zeros(LANGUAGES + 1)

    def words(self, ids: np.ndarray) -> np.ndarray:
        """Each word's vector: the sum of the embeddings of it and its starts."""
        x = self.e[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.e[ids[:, k]]
        return x

    def pooled(self, ids: np.ndarray, n_words: np.ndarray, back: bool = False):
        """The filters' maxima over each document, and for training where they stand."""
        n = np.maximum(n_words, 1)
        start = np.r_[0, np.cumsum(n + _WIDE)[:-1]]
        padded = np.full((int((n + _WIDE).sum()) + _WIDE, ids.shape[1]), BUCKETS, np.int32)
        at = np.repeat(start - np.r_[0, np.cumsum(n_words)[:-1]], n_words) + np.arange(len(ids))
        padded[at] = ids
        x = self.words(padded)
        wide = np.lib.stride_tricks.sliding_window_view(x, _WIDE, 0).transpose(0, 2, 1).reshape(-1, _WIDE * DIM)
        z = wide @ self.w
        pairs = np.stack([start, start + n], 1).ravel()
        top = np.maximum.reduceat(z, pairs, 0)[::2]
        if not back:
            return top, None
        spots = np.empty(top.shape, np.int64)
        for d in range(len(n)):
            spots[d] = start[d] + z[start[d] : start[d] + n[d]].argmax(0)
        return top, (spots, wide, padded)

    def logits(self, ids: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return self.read(self.pooled(ids, n_words)[0])

    def read(self, top: np.ndarray) -> np.ndarray:
        """The logits of the filters' maxima."""
        return np.maximum(top + self.b, 0) @ self.v + self.c

    def shifted(self, logits: np.ndarray, seen: np.ndarray) -> np.ndarray:
        z = logits.astype(np.float64) - self.cuts[language_of(seen)] + np.log(0.7 / 0.3)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """The score of each whole text."""
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        out = [np.zeros(0)]
        for a, b in common.chunks(offsets, block):
            if offsets[b] - offsets[a] > block:
                out.append(self.long_score(data[offsets[a] : offsets[b]], block))
            else:
                ids, n_words, seen = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out.append(self.shifted(self.logits(ids, n_words), seen))
        return np.concatenate(out)

    def long_score(self, data: np.ndarray, block: int) -> np.ndarray:
        """One text by blocks: windows that begin in a block's last two words wait for the next block's words."""
        top, seen, waiting = np.full(self.b.shape, -np.inf, np.float32), np.zeros((1, LANGUAGES), np.int64), np.zeros((0, 1 + len(STEMS)), np.int32)
        for _, part in common.blocks(data, np.array([0, len(data)]), block):
            ids, _, found = encode(data[part[0] : part[-1]], part - part[0])
            seen += found
            ids = np.concatenate([waiting, ids])
            if len(ids) >= _WIDE:
                wide = np.lib.stride_tricks.sliding_window_view(self.words(ids), _WIDE, 0).transpose(0, 2, 1).reshape(-1, _WIDE * DIM)
                top = np.maximum(top, (wide @ self.w).max(0))
                ids = ids[1 - _WIDE :]
            waiting = ids
        if len(waiting) or np.isneginf(top).any():
            top = np.maximum(top, self.pooled(waiting, np.array([len(waiting)]))[0][0])
        return self.shifted(self.read(top[None]), seen)


def _adam(state: dict, key: str, value: np.ndarray, grad: np.ndarray, step: int, rows=slice(None), rate: float = 0.01) -> None:
    m, s = state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
    m[rows] = 0.9 * m[rows] + 0.1 * grad
    s[rows] = 0.99 * s[rows] + 0.01 * grad * grad
    value[rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(s[rows] / (1 - 0.99**step)) + 1e-6)


def gradients(net: Net, ids: np.ndarray, n_words: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted mean log loss by v, b, c and w, and (rows, gradients) of the embeddings that it touches."""
    top, (spots, wide, padded) = net.pooled(ids, n_words, True)
    hidden = np.maximum(top + net.b, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.v + net.c, -30, 30)))
    g = ((p - y) * weight / len(n_words)).astype(net.w.dtype)
    gh = g[:, None] * net.v * (hidden > 0)
    gw = np.einsum("df,dfk->kf", gh, wide[spots]) * net.mask
    gx = (gh[:, :, None] * net.w.T[None]).reshape(*gh.shape, _WIDE, DIM)
    words = padded[spots[:, :, None] + np.arange(_WIDE)]
    live = words[..., 0] != BUCKETS
    touched, where = np.unique(words[live].ravel(), return_inverse=True)
    ge = np.zeros((len(touched), DIM), net.e.dtype)
    np.add.at(ge, where.reshape(-1), np.repeat(gx[live], words.shape[-1], 0))
    return {"v": g @ hidden, "b": gh.sum(0), "c": np.array([g.sum()]), "w": gw, "e": (touched, ge)}


def fit(rows: list, epochs: int = 8, batch: int = 48, seed: int = 7) -> Net:
    """The network of (text, label) rows, 1 for toxic; the same for the same rows. Every fifth row calibrates only."""
    y = np.array([r["label"] for r in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        return Net(float(y.mean()) if len(rows) else 0.5)
    rng = np.random.default_rng(seed)
    net, state, step = Net(seed=seed), {}, 0
    data, offsets = common.text_bytes(pa.array([r["text"] for r in rows], pa.large_string()))
    parts = [encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in common.chunks(offsets)]
    ids, n_words, seen = (np.concatenate(p) for p in zip(*parts, strict=True))
    language = language_of(seen)
    first = np.r_[0, np.cumsum(n_words)]
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 400 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~held)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    epochs = max(epochs, min(60, int(6000 * epochs / 2 / len(train))))
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), batch):
            d, step = train[k : k + batch], step + 1
            grads = gradients(net, np.concatenate([ids[first[i] : first[i + 1]] for i in d]), n_words[d], y[d], weight[d])
            touched, ge = grads["e"]
            _adam(state, "v", net.v, grads["v"] + 1e-4 * net.v, step)
            _adam(state, "b", net.b, grads["b"], step)
            c = np.array([net.c])
            _adam(state, "c", c, grads["c"], step)
            net.c = c[0]
            _adam(state, "w", net.w, grads["w"], step)
            _adam(state, "e", net.e, ge + 1e-5 * net.e[touched], step, touched, 0.02)
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    z = np.array([net.logits(ids[first[i] : first[i + 1]], n_words[i : i + 1])[0] for i in check])
    common_cut = _cut(z, y[check])
    for k in range(LANGUAGES + 1):
        of = language[check] == k
        enough = min((y[check][of] == v).sum() for v in (0, 1)) >= 20
        net.cuts[k] = _cut(z[of], y[check][of]) if enough else common_cut
    return net


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the logits at which the two classes' shares of errors are least in sum."""
    edges = np.r_[z.min() - 1, np.sort(z), z.max() + 1]
    cuts = (edges[1:] + edges[:-1]) / 2
    errors = np.array([((z >= c) & (y == 0)).sum() / max(1, (y == 0).sum()) + ((z < c) & (y == 1)).sum() / max(1, (y == 1).sum()) for c in cuts])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def score(docs: DataFrame, net: Net, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``name``. The weights (a fixed 4 MB) go to the executors as a broadcast variable."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    schema = common.added(docs, [T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            out = held.value.scores(*common.text_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return common.mapped(docs, run, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS) -> Net:
    return fit(common.labelled_sample(docs, labels, "toxic", 3, 1, rows, max_chars))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")), name="score")
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
