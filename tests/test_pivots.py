"""Pivot partitioning against all pairs: nothing within the limit is lost, and few pairs are multiplied."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import pivots, similarity


def frame(spark, rows, id_col, vec):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in rows], f"{id_col} long, {vec} array<double>").repartition(3)


def planted(rng, groups=150, of=8, dim=24, noise=0.02):
    centres = rng.normal(size=(groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.repeat(centres, of, 0) + rng.normal(size=(groups * of, dim)) * noise
    return list(enumerate(rows * rng.uniform(0.5, 2, (len(rows), 1))))


def cosines(rows):
    m = np.array([v for _, v in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(norm > 0, norm, 1)
    return u @ u.T


@pytest.mark.parametrize("limit", [0.9, 0.3])
def test_search_is_exact(spark, limit, monkeypatch):
    rows = planted(np.random.default_rng(1))
    rows += [(5000 + i, rows[0][1]) for i in range(400)] + [(7000, np.zeros(24)), (7001, np.zeros(24))]  # one vector with a quarter of the rows
    monkeypatch.setattr(similarity.pivots.near, "__defaults__", (None, False, 60))
    got = similarity.identity_search(frame(spark, rows, "query_id", "query_vec"), frame(spark, rows, "identity_id", "vec"), 3, limit, 0.95).collect()
    ids, s = np.array([i for i, _ in rows]), cosines(rows)
    want = set()
    for a, i in enumerate(ids):
        best = sorted((-round(float(s[a, b]), 9), int(j)) for b, j in enumerate(ids) if j != i and s[a, b] >= limit - 1e-12)[:3]
        want |= {(int(i), r + 1, j) for r, (_, j) in enumerate(best)}
    pairs = {(r.query_id, r.rank, r.identity_id) for r in got}
    close = {(q, j) for q, _, j in pairs} ^ {(q, j) for q, _, j in want}
    index = {int(i): a for a, i in enumerate(ids)}
    exact_tie = lambda q, j: abs(s[index[q], index[j]] - max(s[index[q], index[x]] for x in (y for p, y in close if p == q))) < 1e-9
    assert len(pairs) == len(want) and all(exact_tie(q, j) for q, j in close)


def test_few_pairs_are_multiplied(spark):
    rows = planted(np.random.default_rng(2))
    known = pivots.usable(frame(spark, rows, "identity_id", "vec"), "identity_id", "vec")
    left, right = pivots.tiles(known, known, 24, True, 0.9, cell_rows=25)
    n = left.groupBy("tile").count().join(right.groupBy("tile").agg(F.count(F.lit(1)).alias("m")), "tile").agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    assert n < len(rows) ** 2 / 5
    met = {(r.a, r.b) for r in left.select("tile", F.col("id").alias("a")).join(right.select("tile", F.col("id").alias("b")), "tile").collect()}
    s = cosines(rows)
    assert all((a, b) in met for a, b in zip(*np.nonzero(s >= 0.9), strict=True))


def test_hot_cell_is_many_tiles(spark):
    """Near copies of one vector, all in one cell: tiles stay within the bound and lose no pair."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, base + rng.normal(size=8) * 1e-3) for i in range(900)]
    known = pivots.usable(frame(spark, rows, "identity_id", "vec"), "identity_id", "vec")
    left, right = pivots.tiles(known, known, 8, True, 0.999, cell_rows=100)
    assert max(r["count"] for side in (left, right) for r in side.groupBy("tile").count().collect()) < 400
    assert pivots.near(frame(spark, rows, "query_id", "query_vec"), frame(spark, rows, "identity_id", "vec"), True, 0.999, cell_rows=100).count() == 900 * 900


def test_distances_and_nothing(spark):
    rng = np.random.default_rng(4)
    probes, known = [(i, rng.normal(size=4)) for i in range(60)], [(i, rng.normal(size=4)) for i in range(100, 400)]
    q, c = frame(spark, probes, "query_id", "query_vec"), frame(spark, known, "identity_id", "vec")
    d = np.linalg.norm(np.array([v for _, v in probes])[:, None] - np.array([v for _, v in known])[None], axis=2)
    got = {(r.query_id, r.identity_id): r.score for r in pivots.near(q, c, False, 1.0, cell_rows=30).collect()}
    assert got.keys() == {(a, b + 100) for a, b in zip(*np.nonzero(d <= 1.0), strict=True)} and all(abs(v - d[a, b - 100]) < 1e-9 for (a, b), v in got.items())
    best = {r.query_id: r.identity_id for r in pivots.near(q, c, False, None, 1, cell_rows=30).collect()}
    assert best == {a: int(b) + 100 for a, b in enumerate(d.argmin(1))}
    other = frame(spark, [(1, np.ones(3))], "identity_id", "vec")
    assert pivots.near(q, other, True, 0.1).count() == 0 == pivots.near(q.limit(0), c, True, 0.1).count() == pivots.near(q, c.limit(0), False, None, 1).count()


def test_steps_are_bounded(monkeypatch):
    """Routing and products hold so many pairs at a time, however many pivots, queries or results there are."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(pivots, "PAIRS", 1 << 12)
    rows = rng.normal(size=(700, 8))
    cells = pivots.Cells(rows[:300], False)
    rings = np.tile([0.0, 9.0], (300, 1))
    whole = cells._reached(rows, rings, 2.0)
    tracemalloc.start()
    parts = list(cells.reached(rows, rings, 2.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [np.concatenate(x).tolist() for x in zip(*parts, strict=True)] == [x.tolist() for x in whole] and peak < 16 * len(whole[0]) + 40 * 8 * pivots.PAIRS
    got = list(pivots.Best(np.arange(700), rows, False, 99.0, None).pieces(np.arange(700), rows))
    assert sum(b.num_rows for b in got) == 700 * 700 and max(b.num_rows for b in got) <= pivots.PAIRS
