"""Very long texts: the block ways give the results of the plain ways, within bounded memory."""

import itertools
import resource
import subprocess
import sys

import numpy as np
import pytest
import xxhash

from evidentia.llm import line_mphf, quality_crf, simhash_bk, toxicity_cnn


def chain():
    rng = np.random.default_rng(3)
    k = quality_crf.line_features(np.frombuffer(b"x\ny", np.uint8), np.array([0, 3]))[0].shape[1]
    return quality_crf.Chain(rng.normal(size=k), np.array([[0.4, -0.3], [-0.2, 0.5]]), (4.0, 0.5))


def text(rng, n):
    words = ["the", "THE", "win!", "|", "1234", "a", "extraordinarily", "***", "\n", "\n", "\n\n", "é"]
    return " ".join(rng.choice(words, n)).encode()


def test_quality_in_blocks():
    c, rng = chain(), np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 700, 4000):
        data = np.frombuffer(text(rng, n), np.uint8)
        score, bad, lines = (x[0] for x in c.quality(data, np.array([0, len(data)])))
        for block in (2000, 5000, 1 << 20):
            assert c.long_quality(data, block) == (pytest.approx(score, abs=1e-9), bad, lines)


def test_quality_with_cut_lines():
    """Blocks that cut lines and words: nothing is lost."""
    c, rng = chain(), np.random.default_rng(6)
    long = b"x" * 90 + b"!"
    texts = [text(rng, 900), b"\n".join([b"the same line " * 20] * 3 + [long, long, long + b" |", b"| " + long]), b" ".join([long] * 4), long * 5, b"\n\n" + long + b"\n", b"ab" * 40 + b" ", b"some words and a " + long + b"\n" + long]
    for data in (np.frombuffer(t, np.uint8) for t in texts):
        score, bad, lines = (x[0] for x in c.quality(data, np.array([0, len(data)])))
        for block in (1, 7, 40, 77, 91, 400):
            assert c.long_quality(data, block) == (pytest.approx(score, abs=1e-9), bad, lines)


def test_chain_by_enumeration():
    """Marginals of chains of up to eight lines against the sum over all labellings."""
    c, rng = chain(), np.random.default_rng(12)
    for n in range(1, 9):
        e = rng.normal(size=n) * 2
        weights = {}
        for labels in itertools.product((0, 1), repeat=n):
            energy = sum(x for x, y in zip(e, labels, strict=True) if y) + sum(c.t[a, b] for a, b in itertools.pairwise(labels))
            weights[labels] = np.exp(energy)
        total = sum(weights.values())
        want = [sum(w for y, w in weights.items() if y[i]) / total for i in range(n)]
        pairs = np.array([[sum(w * sum(p == (a, b) for p in itertools.pairwise(y)) for y, w in weights.items()) / total for b in (0, 1)] for a in (0, 1)])
        p, pair = c.marginals(e, np.array([n]))
        assert np.allclose(p, want) and np.allclose(pair, pairs)
        assert np.allclose(quality_crf._segmented(e, c.top(), False)[0], want)


def test_segments_and_loop_agree():
    c, rng = chain(), np.random.default_rng(7)
    e = rng.normal(size=400) * 3
    fwd, back = c.messages(e, np.array([400]))
    f, b = quality_crf._segmented(e, c.top(), True)
    assert np.allclose(f, fwd[:, 1]) and np.allclose(b, back[:, 1])
    p, pair = c.marginals(e, np.array([150, 250]))
    assert np.allclose(np.r_[quality_crf._segmented(e[:150], c.top(), False)[0], quality_crf._segmented(e[150:], c.top(), False)[0]], p)
    assert pair.sum() == pytest.approx(398)


MEMORY = """
import resource, numpy as np
from evidentia.llm import line_mphf, quality_crf, simhash_bk, toxicity_cnn
from tests.llm.test_long_texts import chain
text = {text}
data = np.frombuffer(text, np.uint8)
{run}
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
QUALITY = "chain().all_quality(data, np.array([0, len(data)]))"
PRINTS = "simhash_bk.fingerprints(data, np.array([0, len(data)]))"
TOXIC = "toxicity_cnn.Net().scores(data, np.array([0, len(data)]))"
LINES = "n, a, b, _ = line_mphf._keyed(text, 40); line_mphf.without(text, list(zip(a, b)))"
WORDS, BREAKS, SHORT = "b'some words of a text, ' * 2_200_000", "b'\\n' * 20_000_000", "b'ab\\n' * 20_000_000"


@pytest.mark.parametrize(("text", "run"), [(BREAKS, QUALITY), (WORDS, QUALITY), (WORDS, PRINTS), (WORDS, TOXIC), (SHORT, TOXIC), (SHORT, LINES), (WORDS, LINES)])
def test_memory(text, run):
    out = subprocess.run([sys.executable, "-c", MEMORY.format(text=text, run=run)], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) < 1000


def test_fingerprints_in_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [text(rng, n) for n in (0, 1, 3, 4, 5, 300, 2000)] + [b"  \t ", b"one", b"A b C d  E"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = simhash_bk.fingerprints(data, offsets)
    monkeypatch.setattr(simhash_bk.common, "CHUNK_BYTES", 50)
    assert (simhash_bk.fingerprints(data, offsets) == whole).all()
    for t, got in zip(texts, whole.tolist(), strict=True):
        words = t.lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        assert got == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_hot_shard(spark):
    """Many near fingerprints in one shard: cut to trees and blocks of probes, the links are those of all pairs."""
    rng = np.random.default_rng(9)
    keys = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 14, (300, 3)).astype(np.uint64), 1) for base in rng.integers(0, 2**62, 4).astype(np.uint64)]))
    rows = [(int(k.view(np.int64)), i) for i, k in enumerate(keys)]
    edges = simhash_bk.components(simhash_bk.links(spark.createDataFrame(rows, "fingerprint long, node long"), len(rows), tree_keys=100)).collect()
    got = np.arange(len(keys))
    for e in edges:
        got[e.node] = e.component
    label = np.arange(len(keys))
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= simhash_bk.RADIUS
    while True:
        new = np.where(near, label[None], len(keys)).min(1)
        if (new == label).all():
            break
        label = new
    assert (got == label).all() and len(set(label.tolist())) < len(keys)


def test_dense_tree_is_quick():
    """Twenty thousand keys that are all linked: time by processor, so that other work doesn't count."""
    rng = np.random.default_rng(10)
    keys = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 40, (40_000, 2)).astype(np.uint64), 1))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_utime
    src, dst = simhash_bk.linked(keys, np.ones(len(keys), bool), np.arange(len(keys)), 4)
    assert len(src) == len(keys) - 1 and set(dst.tolist()) == {0}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_utime - before < 30


def test_toxicity_in_blocks():
    """Filters' maxima by blocks are those of whole texts and of every window by itself."""
    rng, net = np.random.default_rng(13), toxicity_cnn.Net(seed=3)
    net.cuts = rng.normal(size=toxicity_cnn.LANGUAGES + 1)
    words = ["the", "der", "bad", "Ü", "x", "longerword", "a-b", "\n", "--", "la"]
    for n in (0, 1, 2, 3, 5, 60, 800):
        t = " ".join(rng.choice(words, n)).encode()
        data, ends = np.frombuffer(t, np.uint8), np.array([0, len(t)])
        ids, n_words, seen = toxicity_cnn.encode(data, ends)
        vectors = np.concatenate([net.e[ids].sum(1), np.zeros((3, toxicity_cnn.DIM))])
        top = [max(sum(vectors[i + k] @ net.w[k * toxicity_cnn.DIM : (k + 1) * toxicity_cnn.DIM, f] for k in range(width)) for i in range(max(1, int(n_words[0])))) for f, width in enumerate(np.repeat(toxicity_cnn.WIDTHS, toxicity_cnn.FILTERS))]
        whole = net.scores(data, ends)
        assert np.allclose(net.pooled(ids, n_words)[0][0], top, atol=1e-5)
        assert np.allclose(whole, net.shifted(net.read(np.array([top], np.float32)), seen), atol=1e-5)
        for block in (1, 9, 50, 700):
            assert np.allclose(net.scores(data, ends, block), whole, atol=1e-6)


def test_toxicity_gradient():
    """Each weight's gradient in one step of the training's loss, against differences."""
    rng, net = np.random.default_rng(14), toxicity_cnn.Net(seed=4)
    data, offsets = b"bad words here the end of it", np.array([0, 9, 28])
    ids, n_words, _ = toxicity_cnn.encode(np.frombuffer(data, np.uint8), offsets)
    for name in ("w", "b", "v", "e"):
        setattr(net, name, getattr(net, name).astype(np.float64) * (5 if name == "e" else 1))
    net.b = net.b + 0.3
    y, weight = np.array([1.0, 0.0]), np.array([0.7, 1.3])
    loss = lambda: (weight * (np.logaddexp(0, net.logits(ids, n_words)) - y * net.logits(ids, n_words))).sum() / 2
    grads = toxicity_cnn.gradients(net, ids, n_words, y, weight)
    for name in ("v", "b", "w"):
        value, g = getattr(net, name), grads[name]
        for _ in range(12):
            at = tuple(int(rng.integers(0, k)) for k in value.shape)
            if name == "w" and not net.mask[at]:
                assert g[at] == 0
                continue
            old, (low, high) = value[at], (0.0, 0.0)
            value[at] = old + 1e-6
            high = loss()
            value[at] = old - 1e-6
            low = loss()
            value[at] = old
            assert g[at] == pytest.approx((high - low) / 2e-6, abs=1e-6)
    rows, g = grads["e"]
    for k in range(0, len(rows), max(1, len(rows) // 8)):
        old = net.e[rows[k], 2]
        net.e[rows[k], 2] = old + 1e-6
        high = loss()
        net.e[rows[k], 2] = old - 1e-6
        low = loss()
        net.e[rows[k], 2] = old
        assert g[k, 2] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def test_lines_without_objects():
    rng = np.random.default_rng(15)
    for n in (0, 1, 2, 5, 60):
        lines = [b"".join(rng.choice([b"a", b"bc", b" "], int(rng.integers(0, 9)))) for _ in range(n)]
        t = b"\n".join(lines)
        count, starts, ends = line_mphf.long_lines(t, 3)
        assert count == len(t.split(b"\n")) and [t[a:b] for a, b in zip(starts, ends, strict=True)] == [x for x in t.split(b"\n") if len(x) >= 3]
        every = np.cumsum([0] + [len(x) + 1 for x in lines])
        for _ in range(20):
            gone = set(rng.choice(n, int(rng.integers(0, n + 1)), replace=False).tolist()) if n else set()
            spans = [(int(every[i]), int(every[i]) + len(lines[i])) for i in sorted(gone)]
            assert line_mphf.without(t, spans) == b"\n".join(x for i, x in enumerate(lines) if i not in gone)
