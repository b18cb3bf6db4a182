"""R-trees and score windows against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import rtree_negatives as rt

SCHEMA = "vec_id long, label int, embedding array<float>, score double, window long, dim string"


def brute(rows, every):
    """rows: (id, label, integer vector), one for each id."""
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        scored = [(int(np.dot(va, v)), i, la == label) for i, label, v in rows if i != a and len(v) == len(va)]
        for p, pid, _ in sorted((x for x in scored if x[2]), key=lambda x: (-x[0], x[1]))[:5]:
            fits = sorted((x for x in scored if not x[2] and 80 * p <= 100 * x[0] <= 100 * p), key=lambda x: (-x[0], x[1]))[:5]
            out += [(a, pid, k + 1, n, p, s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every, **bounds):
    df = spark.createDataFrame([(i, label, v, 0.0, 1, "x") for i, label, v in rows], SCHEMA)
    got = rt.mine(df, F.col("vec_id") % every == 0, **bounds).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def quantised(rows):
    return [(i, label, np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int)) for i, label, v in rows]


@pytest.mark.parametrize("bounds", [{}, {"tree_rows": 40, "slice_bytes": 700}])
def test_against_all_products(spark, bounds):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, int(k := rng.integers(0, 6)), (centres[k] * 0.2 + rng.normal(size=12) * 0.15).tolist()) for i in range(330)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(150)]  # one vector with a third of the rows
    rows += [(2000 + i, 1, [0.5, 0.25, 0.125]) for i in range(12)] + [(2100 + i, 2, [0.45, 0.25, 0.125]) for i in range(7)]
    got = mined(spark, rows, 10, **bounds)
    assert len(got) > 500 and got == brute(quantised(rows), 10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.8, 0.0]), (3, 2, [0.8, 0.0]), (4, 1, [-1.0, 0.0]), (5, 3, [0.72, 5.0]), (100, 7, [1.0, 1.0]), (200, -3, [0.0, 0.0]), (201, -3, [1.0, 0.0])]
    bad = [(10, None, [1.0, 0.0]), (11, 1, None), (12, 1, [1.0, None]), (13, 1, [nan, 0.0]), (14, 2, [inf, 0.0]), (None, 2, [0.85, 0.0]), (15, 2, []), (16, 2, [3e8, 0.0])]
    want = brute(quantised(good), 100)
    assert want and mined(spark, good + bad, 100) == want
    assert mined(spark, good + good[2:4] + [(2, 2, [0.9, 0.9])] + bad, 100) == want  # repeated ids count once, with the least vector
    assert mined(spark, [], 100) == [] == mined(spark, bad, 100)


def test_large_scores(spark):
    big = 200_000.0
    rows = [(0, 1, [big] * 8), (1, 1, [big - 1] * 8), (2, 2, [big - 2] * 8), (3, 2, [big * 0.7] * 8), (4, 3, [big * 0.81] * 8)]
    got = mined(spark, rows, 100)
    want = brute([(i, label, np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(object)) for i, label, v in rows], 100)
    assert got == want and [r[3] for r in got] == [2, 4] and got[0][4] > 2**53


def test_boxes_hold_their_rows_and_prune():
    """Bounds enclose all products; on clustered vectors few leaves are opened, and the result is that of all products."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (40, 6))
    vectors = (centres[rng.integers(0, 40, 8000)] + rng.integers(-6, 6, (8000, 6))).astype(np.int64)
    labels, ids = rng.integers(0, 3, 8000), rng.permutation(8000)
    tree = rt.Tree(ids, labels, vectors)
    anchor = vectors[17]
    low, high = (x[0] for x in tree.bounds(anchor[None]))
    scores = tree.vectors @ anchor
    for node in range(tree.leaves):
        a, b = tree.spans[node]
        assert low[node] <= scores[a:b].min() and scores[a:b].max() <= high[node] and len(set(tree.labels[a:b].tolist())) == 1
    top = int(scores[tree.labels != labels[17]].max())
    windows = rt.Windows(np.array([top * 8 // 10, top // 2]), np.array([top, top * 6 // 10]), 5)
    opened = rt.explore(tree, anchor, int(ids[17]), int(labels[17]), False, low, high, windows)
    for k, heap in enumerate(windows.heaps):
        inside = [(int(s), -int(i)) for s, i, x in zip(scores, tree.ids, tree.labels, strict=True) if x != labels[17] and windows.low[k] <= s <= windows.high[k]]
        assert sorted(heap) == sorted(inside)[-5:]
    assert opened < tree.leaves / 4


def test_exact_products():
    a = np.array([[2**26 - 1] * 64, [3] * 64])
    assert rt.products(a, a.T).tolist() == [[64 * (2**26 - 1) ** 2, 192 * (2**26 - 1)], [192 * (2**26 - 1), 576]]
