"""Ranked search against counting every term of every document."""

import math
import re

import numpy as np
import pytest

from evidentia.llm import range_max_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, k=10):
    found = [(i, w) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n_docs, length = len(found), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        ranked = []
        for i, w in found:
            m = 100 - 75 + 75 * len(w) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms(text) if t in df)
            if score > 0:
                ranked.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(ranked, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **bounds):
    left = spark.createDataFrame([(i, t, 1, ["x"]) for i, t in docs], "doc_id long, text string, n long, terms array<string>").repartition(3)
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item long")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rs.search(left, right, **bounds).collect()), key=str)


def corpus(rng):
    words = [f"w{k}" for k in range(60)] + ["Ähre", "été", "MIXED", "x" * 40]
    weight = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    docs = [(int(i), text(int(rng.integers(0, 60)))) for i in rng.permutation(250)] + [(500 + k, "w3 w3, W50-w51") for k in range(15)]
    items = [(k, text(int(rng.integers(1, 9)))) for k in range(12)] + [(20, "w50 w51 w3"), (21, "absent"), (22, ""), (23, None), (20, "w50 w51 w3"), (20, "w59"), (None, "mixed W1 w1")]
    return docs + [(None, "w3 w3 w50 w51"), (7, "w50 w51"), (7, "w50 w51"), (600, None), (601, "!!! \x00"), (602, "w50 " * 5000)], items


@pytest.mark.parametrize("bounds", [{}, {"slice_words": 9, "shard_postings": 150}])
def test_against_counting(spark, bounds, monkeypatch):
    monkeypatch.setattr(rs, "LEAF_POSTINGS", 6)
    docs, items = corpus(np.random.default_rng(6))
    got = searched(spark, docs, items, **bounds)
    assert len(got) > 100 and got == brute(docs, items)


def test_empty(spark):
    docs, items = corpus(np.random.default_rng(7))
    assert searched(spark, [], items) == [] == searched(spark, docs, []) == searched(spark, [(1, None), (2, "..")], items)


def shard(rng, n, vocabulary):
    doc, term, tf = [], [], []
    for d in range(n):
        for t in sorted(set((rng.zipf(1.4, 12) % vocabulary).tolist())):
            doc.append(d)
            term.append(t)
            tf.append(int(rng.integers(1, 6)))
    return np.array(doc), np.array(term), np.array(tf)


def test_intervals(monkeypatch):
    """Sparse tables give range maxima; whatever the leaf size, the search gives the k best and leaves documents unscored."""
    rng = np.random.default_rng(8)
    doc, term, tf = shard(rng, 3000, 300)
    weight = rng.integers(1, 9000, 300)
    lengths = rng.integers(5, 90, 3000)
    s = rs.Shard(lengths, doc, term, tf, weight, 3000, int(lengths.sum()))
    for _ in range(300):
        a, b = sorted(rng.integers(0, len(doc), 2).tolist())
        t = int(rng.integers(0, 300))
        a, b = (int(np.clip(x, s.ends[t], s.ends[t + 1])) for x in (a, b))
        got = int(s.top(np.array([a]), np.array([b]))[0])
        assert got == -1 if a == b else a <= got < b and s.impact[got] == s.impact[a:b].max()
    unscored = 0
    for leaf in (0, 5, 400):
        monkeypatch.setattr(rs, "LEAF_POSTINGS", leaf)
        for _ in range(10):
            asked = np.unique(rng.integers(0, 300, 6))
            times = rng.integers(1, 4, len(asked))
            best = rs.Best(10)
            best.ids = list(range(3000))
            unscored += 3000 - s.search(asked, times, best)
            total = np.zeros(3000, np.int64)
            for t, c in zip(asked, times, strict=True):
                a, b = s.ends[t], s.ends[t + 1]
                np.add.at(total, s.rows[s.doc[a:b]], c * s.impact[a:b])
            want = sorted(((int(x), -i) for i, x in enumerate(total) if x), reverse=True)[:10]
            assert sorted(((x[0], x[1]) for x in best.heap), reverse=True) == want
    assert unscored > 3000


def test_counting_in_blocks():
    """Long texts cut between words give the counts of whole ones; words longer than a block stay whole."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["aa", "B", "ccc" * 30, "é", "zz-top"], int(n))).encode() for n in (0, 3, 400, 1, 90)] + [b"q" * 500]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    found = rs.Terms([b"aa", b"b", b"ccc" * 30, "é".encode(), b"top", b"q" * 500])
    whole = rs.counted(data, offsets, found)
    assert whole[0].tolist() == [len(terms(t.decode())) for t in texts]
    for limit in (7, 50, 1000):
        assert all((a == b).all() for a, b in zip(whole, rs.counted(data, offsets, found, limit), strict=True))
    for d, t, tf in zip(*whole[1:], strict=True):
        word = next(w for w, k in found.number.items() if k == t).decode()
        assert terms(texts[d].decode()).count(word) == tf
