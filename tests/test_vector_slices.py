"""A search that leaves no cell out shuffles no vectors: cells are broadcast slice by slice, with the same results."""

import numpy as np
import pytest

from evidentia.operators import pivots, similarity

from test_pivots import frame, planted


def shuffled(spark):
    """Bytes that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_vectors_are_not_copied_by_the_square_of_the_rows(spark, monkeypatch):
    rows = planted(np.random.default_rng(6), groups=300)
    monkeypatch.setattr(similarity.pivots.near, "__defaults__", (None, False, 40))
    before = shuffled(spark)
    assert similarity.identity_search(frame(spark, rows, "query_id", "query_vec"), frame(spark, rows, "identity_id", "vec"), 3, 0.0, 0.95).count() == 3 * len(rows)
    assert shuffled(spark) - before < 12 * len(rows) * 24 * 8


@pytest.mark.parametrize(("cosine", "limit", "k"), [(True, 0.3, 3), (True, 0.9, 2), (False, None, 1), (False, 1.0, 5)])
def test_slices_have_the_rows_of_tiles(spark, monkeypatch, cosine, limit, k):
    rows = planted(np.random.default_rng(8), groups=60)
    rows += [(5000 + i, rows[0][1]) for i in range(40)] + [(6000 + i, rows[0][1] * (1 + i / 1e4)) for i in range(200)] + [(7000, np.zeros(24))]
    found = []
    for copies, size in ((1 << 40, 1 << 24), (0, 1 << 24), (0, 50 * 24 * 8)):  # tiles, one slice, many slices and a cell in parts
        monkeypatch.setattr(pivots, "COPIES", copies)
        monkeypatch.setattr(pivots, "SLICE_BYTES", size)
        got = pivots.near(frame(spark, rows[::2], "query_id", "query_vec"), frame(spark, rows, "identity_id", "vec"), cosine, limit, k, True, 60)
        order = lambda r: (r.query_id, -r.score if cosine else r.score, r.identity_id)
        best = {}
        for r in sorted(got.collect(), key=order):
            best.setdefault(r.query_id, []).append((r.identity_id, r.score))
        found.append({q: x[:k] for q, x in best.items()})
    assert found[0] and found[0] == found[1] == found[2]


def test_slices_of_cells():
    n = np.array([3, 4, 0, 25, 2, 9])
    parts = list(pivots._slices(n, 10))
    assert parts == [(0, 3, 0, 1), (3, 4, 0, 3), (3, 4, 1, 3), (3, 4, 2, 3), (4, 5, 0, 1), (5, 6, 0, 1)]
