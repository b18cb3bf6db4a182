"""Line dedup's index: every distinct key has its real count, and both ways of probing give the same rows."""

import os

import numpy as np
import pytest

from evidentia.llm import common, line_mphf

LINES = [f"a line of some length that has the number {i} in it" for i in range(60)]


def documents(spark):
    rows = [(d, "\n".join([LINES[(d * 7 + k * k) % 60] for k in range(9)] + [f"only here {d}"] + [LINES[0]] * (d % 2))) for d in range(40)]
    return spark.createDataFrame([*rows, (None, LINES[0]), (7, LINES[1]), (3, None)], "doc_id long, text string").repartition(3)


def brute(rows, min_docs):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(line) >= 40:
                holders.setdefault(line, set()).add(d)
    gone = lambda d, line: d is not None and len(holders.get(line, ())) >= min_docs and max(holders[line]) != d
    return sorted((str(d), "\n".join(x for x in (t or "").split("\n") if not gone(d, x))) for d, t in rows)


@pytest.mark.parametrize("options", [{}, {"shard_keys": 8}, {"shard_keys": 8, "group_bytes": 0}, {"shard_keys": 8, "group_bytes": 0, "task_probes": 5}])
def test_both_ways(spark, options):
    docs = documents(spark)
    got = sorted((str(r.doc_id), r.dedup_text) for r in line_mphf.drop_lines(docs, 40, 5, **options).collect())
    assert got == brute([tuple(r) for r in docs.collect()], 5)


def test_counts_are_real(spark):
    docs = documents(spark)
    keys = common.checkpointed(line_mphf.counted(docs, 40))
    index = line_mphf.Index(line_mphf.build(keys, 3).collect(), 3)
    rows = keys.collect()
    place, prints = (np.array([r[c] for r in rows], np.int64) for c in ("place", "fingerprint"))
    count, keeper = index.probe(place, prints)
    assert count.tolist() == [r.n_docs for r in rows] and keeper.tolist() == [r.keeper for r in rows] and min(count) < 5 <= max(count)
    assert not index.probe(place + 1, prints)[0].any() and not index.probe(place, prints + 1)[0].any()
    assert sum(s.perfect.n for s in index.parts.values()) == len(rows)


def test_shared_places(spark):
    """Keys of one place are all kept and told apart."""
    rows = [(5, 1, 9, 90), (5, 2, 3, 91), (5, 2**40 + 2, 7, 92), (6, 1, 4, 93)]
    index = line_mphf.Index(line_mphf.build(spark.createDataFrame(rows, "place long, fingerprint long, n_docs long, keeper long"), 1).collect(), 1)
    count, keeper = index.probe(*(np.array([r[c] for r in rows], np.int64) for c in (0, 1)))
    assert list(zip(count.tolist(), keeper.tolist(), strict=True)) == [r[2:] for r in rows]
    assert index.probe(np.array([5, 7]), np.array([3, 1]))[0].tolist() == [0, 0]


def test_dealt_way_writes_no_texts(spark):
    """Checkpoints hold keys and the index, whatever the number of shards."""
    docs = spark.createDataFrame([(d, "\n".join(LINES[:3]) + " filler" * 5000) for d in range(30)], "doc_id long, text string")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(common.shared_dir(spark).removeprefix("file:")) for f in names)
    before = size()
    line_mphf.drop_lines(docs, 40, 5, shard_keys=1, group_bytes=0).count()
    assert size() - before < 100_000
