"""The operators' results against SQL, brute force and held-out labels on the driver's small tables."""

import os
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import common, gumbel_pieces, license_diagonals, queries, simhash_bk

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(plain, df.select(*names).collect()))) == sorted(map(str, map(plain, found.fetchall())))


@pytest.mark.parametrize(("name", "label"), [("op1_quality_crf", "quality"), ("op4_toxicity_cnn", "toxic")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where(f"held_out AND {label} IS NOT NULL")
    n, right = got.agg(F.count("*"), F.count_if(F.col("predicted") == F.col(label))).first()
    assert n > 50 and right / n >= 0.9


def test_licenses(spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    texts = [r.text for r in common.table(spark, SF, "documents").select("text").collect()]
    texts += ["Under the MIT license; under THE mit License. cc-by-nc", "Permission is hereby granted, free of charge, to a person obtaining a copy of this software and documentation files (the Software), to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_diagonals.scan(docs).collect()}
    for i, t in enumerate(texts):
        w, starts, labels = words(t), [], set()
        for phrase, label in license_diagonals.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "mit" in got[len(texts) - 1].labels and got[len(texts) - 1].n_base == 0


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def components(ids, prints, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {ids[a]: ids[find(a)] for a in range(len(ids))}


def test_near_duplicates(spark):
    rows = sorted((r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect())
    got = {r.doc_id: r for r in queries.queries()["op10_simhash_bk"](spark, SF).collect()}
    prints = [fingerprint(t) for _, t in rows]
    assert [got[i].fingerprint for i, _ in rows] == [f"{p:016x}" for p in prints]
    assert {i: got[i].component_id for i, _ in rows} == components([i for i, _ in rows], prints, 4)


@pytest.mark.parametrize("tree_keys", [7, 20_000])
def test_links_of_dense_fingerprints(spark, tree_keys):
    """Random fingerprints and neighbours a few bits away, in shards cut to small trees and in whole ones."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 7), replace=False)) for b in base for _ in range(25)}
    ids, prints = list(range(len(prints))), sorted(prints)
    nodes = spark.createDataFrame(list(zip(prints, ids, strict=True)), "fingerprint long, node long")
    found = {r.node: r.component for r in simhash_bk.components(simhash_bk.links(nodes, len(ids), tree_keys=tree_keys)).collect()}
    assert {i: found.get(i, i) for i in ids} == components(ids, prints, 4)


def test_finer_blocks_lose_no_link(spark, monkeypatch):
    """With shards wanted so small that the blocks are cut finer, the links are those of brute force."""
    monkeypatch.setattr(simhash_bk, "SHARD_MEAN", 1e-4)
    rng = np.random.default_rng(5)
    base = [int(b) for b in rng.integers(0, 2**63, 20, dtype=np.uint64)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(63, d, replace=False)) for b in base for d in range(7)})
    assert simhash_bk.blocks_for(len(prints)) > 5
    nodes = spark.createDataFrame(list(zip(prints, range(len(prints)), strict=True)), "fingerprint long, node long")
    found = {r.node: r.component for r in simhash_bk.components(simhash_bk.links(nodes, len(prints))).collect()}
    assert {i: found.get(i, i) for i in range(len(prints))} == components(list(range(len(prints))), prints, 4)


def test_samples_follow_the_lattice():
    """First draws follow the segmentations' probabilities; samples are distinct; weights of inclusion sum to one on average."""
    v = gumbel_pieces.load()
    text = b" ".join([b"inner"])
    lookup = {}
    for i, t in enumerate(v.bytes):
        if t and i not in set(v.byte_ids.tolist()):
            lookup.setdefault(t, i)
    all_ways = {}

    def walk(rest, ids):
        if not rest:
            all_ways[tuple(ids)] = sum(v.logp[i] for i in ids)
        for k in range(1, len(rest) + 1):
            if rest[:k] in lookup:
                walk(rest[k:], [*ids, lookup[rest[:k]]])

    walk(b" " + text, [])
    total = np.logaddexp.reduce(list(all_ways.values()))
    n, first, weight = 4000, {}, 0.0
    for samples in gumbel_pieces.sample(v, [text] * n, gumbel_pieces.row_keys(list(range(n))), 3):
        ids = [tuple(s[0].tolist()) for s in samples]
        assert len(set(ids)) == 3 and samples[0][3] >= samples[1][3] >= samples[2][3]
        assert all(abs(s[2] - (all_ways[i] - total)) < 1e-9 for s, i in zip(samples, ids, strict=True))
        first[ids[0]] = first.get(ids[0], 0) + 1
        weight += sum(np.exp(s[2] - s[4]) for s in samples)
    for ids, logp in all_ways.items():
        p = np.exp(logp - total)
        assert abs(first.get(ids, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    assert abs(weight / n - 1) < 0.05


def test_samples_dont_depend_on_batches(spark):
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    v = gumbel_pieces.load()
    one = {(r.doc_id, r.sample): r.ids_sha256 for r in gumbel_pieces.encode(docs.repartition(1), v).collect()}
    many = {(r.doc_id, r.sample): r.ids_sha256 for r in gumbel_pieces.encode(docs.repartition(7), v).collect()}
    assert one == many


def test_language(spark):
    got = queries.queries()["op5_langid_fusion"](spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "pages"), "page_id")
    path = F.regexp_extract("url", r"example\.[a-z]+/([a-z]{2})/", 1)
    n, right = got.where(path != "").agg(F.count("*"), F.count_if(path == F.col("lang"))).first()
    assert n > 100 and right / n > 0.95


def test_language_posterior_by_hand(spark):
    """The fused posterior of a few pages, recomputed from the same likelihoods with plain sums."""
    from evidentia.llm import langid_fusion as lf

    model = lf.train(common.table(spark, SF, "documents"), 50)
    rows = [(i, f"http://{'a' if i % 2 else 'b.c'}.example.{'de' if i % 3 else 'fr'}/", f"<html lang={'de' if i % 2 else 'fr'}><p>{'der die und ' if i % 2 else 'le la les '}</p>" * (i % 4)) for i in range(9)]
    got = {r.page_id: r for r in lf.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    k, read = len(model.languages), []
    for i, url, html in rows:
        ll, n = model.of(lf.visible(html.encode()))
        e = np.exp(ll - ll.max())
        host = re.match(r".*?://([^/]*)", url)[1]
        read.append((i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], lf.declared(html.encode()), ll - ll.max(), e / e.sum() if n else np.zeros(k)))
    said = len({r[4] for r in read})
    for i, host, domain, suffix, d, ll, post in read:
        prior = np.full(k, 1 / k)
        for match in (lambda r: True, lambda r: r[3] == suffix, lambda r: r[2] == domain, lambda r: r[1] == host):
            own = np.maximum(sum(r[6] for r in read if match(r)) - post, 0)
            prior = (own + lf.KAPPA * prior) / (own.sum() + lf.KAPPA)
        rate = (np.maximum(sum(r[6] for r in read if r[4] == d) - post, 0) + lf.ALPHA) / (np.maximum(sum(r[6] for r in read) - post, 0) + lf.ALPHA * said)
        logs = ll + np.log(prior) + np.log(rate)
        want = np.exp(logs - np.logaddexp.reduce(logs))
        assert np.allclose([got[i].posteriors[x] for x in model.languages], want, atol=1e-6)


def test_pipeline_stages_by_brute_force(spark):
    """Each filter's decisions, recomputed from the stage's own input."""
    docs = common.table(spark, SF, "documents")
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert 0 < kept.count() < docs.count()
    lines = corpus_pipeline.line_stage(spark, docs, SF)
    rows = {r.doc_id: r.text for r in docs.collect()}
    key = lambda x: lowered(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows.items():
        for k in {key(x) for x in t.split("\n")}:
            holders.setdefault(k, []).append(i)
    drop = lambda i, x: len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i
    want = {i: "\n".join(x for x in t.split("\n") if not drop(i, x)) for i, t in rows.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, len(t)) for i, t in want.items()}
    ids = sorted(rows)
    group = components(ids, [fingerprint(rows[i]) for i in ids], 4)
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()} == {i for i in ids if group[i] == i}
    final = corpus_pipeline.run(spark, SF)
    assert final.count() and not final.where("NOT decodes").count()
