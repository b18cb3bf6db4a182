"""The splitting tree, the mix itself and the words taken, against plain counting."""

import re
from collections import defaultdict

import numpy as np
import pytest

from evidentia.llm import split_mixing as sm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, s, t, 0, "x") for i, s, t in rows], "doc_id long, source string, text string, size long, number string").repartition(3)


def corpus(rng):
    rows = [(i, f"s{min(9, int(rng.integers(0, 14)))}", " ".join(f"w{i}_{k}" for k in range(int(rng.integers(0, 90))))) for i in range(300)]
    return rows + [(900, None, "a b c"), (901, None, None), (902, "empty", ""), (903, "empty", " \t\n"), (904, "z", "one word  two\x0bthree"), (904, "z", "one word  two\x0bthree"), (None, "s1", "of no id")]


def levels(sizes):
    """Targets by handing out what is left, by weight, until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, list(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_taken(spark):
    rows = corpus(np.random.default_rng(1))
    got = sm.taken(docs_of(spark, rows), block_least=8, shard_words=200).collect()
    again = sm.taken(docs_of(spark, rows[::-1]), block_least=8, shard_words=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, source = defaultdict(int), {i: s for i, s, _ in rows}
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, sums = levels(sizes), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        assert want[s] < sizes[s] or r.taken >= r.size  # the first epoch is whole before the second begins
        sums[s] += r.taken
    assert all(sums[s] == int(want[s] + 0.5) for s in want)
    assert next(r for r in got if r.doc_id == 904).size == 3


def test_mix(spark):
    """Pieces hold their document's words; shards are disjoint, of one size, shuffled, and add up to what is taken."""
    rows = corpus(np.random.default_rng(2))
    docs = docs_of(spark, rows)
    got = sm.mix(docs, block_least=8, shard_words=200).collect()
    text = {i: WORD.findall(t or "") for i, _, t in rows}
    sums, shards, words = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in got:
        assert r.text.split(" ") == text[r.doc_id][r.first_word : r.first_word + r.n_words]
        sums[r.doc_id] += r.n_words
        shards[r.shard].append(r.position)
        words[r.shard] += r.n_words
    assert all(sorted(p) == list(range(len(p))) for p in shards.values()) and len(shards) > 10
    assert max(words.values()) < 2 * min(words.values()) + 16
    want = defaultdict(int)
    for r in sm.taken(docs, block_least=8, shard_words=200).collect():
        want[r.doc_id] += r.taken
    assert {i: n for i, n in want.items() if n} == dict(sums)
    first = [r.doc_id for r in sorted((r for r in got if r.shard == 0), key=lambda r: r.position)]
    assert first != sorted(first, key=lambda i: (i is None, i))


def test_tree():
    """Ranges of all shards cover the quotas once, shards have their capacity, and parts of the tree agree with the whole."""
    quotas = np.array([0, 1, 700, 50, 3, 1246])
    whole = sm.split(quotas, 13, 0, 13)
    assert (whole[0][0] == 0).all() and (whole[-1][1] == quotas).all()
    assert all((a[1] == b[0]).all() for a, b in zip(whole, whole[1:], strict=False))
    assert [int((b - a).sum()) for a, b in whole] == [2000 * (k + 1) // 13 - 2000 * k // 13 for k in range(13)]
    part = sm.split(quotas, 13, 4, 9)
    assert all((p[0] == w[0]).all() and (p[1] == w[1]).all() for p, w in zip(part, whole[4:9], strict=True))
    # the first shard's share over many seeds has a hypergeometric draw's mean and variance
    draws = np.array([(lambda r: r[1] - r[0])(sm.split(quotas, 4, 0, 1, seed)[0]) for seed in range(3000)])
    n, k, m = 2000, 700, 500
    assert abs(draws[:, 2].mean() - m * k / n) < 1
    assert draws[:, 2].var() == pytest.approx(m * k / n * (1 - k / n) * (n - m) / (n - 1), rel=0.1)


def test_words():
    assert sm.block_words(1000) == sm.BLOCK_WORDS and 1.5 * 10**15 / sm.block_words(10**15) <= sm.MAX_BLOCKS


def test_nothing_to_mix(spark):
    docs = docs_of(spark, corpus(np.random.default_rng(3)))
    assert sm.taken(docs.limit(0)).count() == 0 == sm.mix(docs.limit(0)).count()
    empty = sm.taken(docs_of(spark, [(1, "a", ""), (1, "a", ""), (2, None, None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in empty) == [(1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_one_long_text(spark):
    got = sm.taken(docs_of(spark, [(1, "a", "word " * 400_000), (2, "b", "x y"), (3, "c", "lone")])).collect()
    assert {r.doc_id: (r.size, r.taken) for r in got} == {1: (400_000, 600_001), 2: (2, 4), 3: (1, 2)} or sum(r.taken for r in got) in (600_004, 600_005)
