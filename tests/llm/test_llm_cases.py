"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import ann_tiles, common, gumbel_pieces, langid_fusion, license_diagonals, line_mphf, quality_crf, simhash_bk, spaced_decontam, toxicity_cnn, url_cascade

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LINE = "this very same line of text stands in several of the documents here"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, words array<string>, place int, seed long, fingerprint string, dedup_text string, quality_score double, node int, component_id string, ids array<int>, sample int, row int, hash long"


def odd_texts():
    return ["", None, "   \n\t ", "word", "one two three four five six seven", LINE, "é" * 50, "a" * 300_000, ("tok" * 3 + " ") * 60_000, "\n" * 3000, "\u0000\u0001 \ufffd \U0001f600 ▁x", "line one\n" + LINE + "\nline three"]


def odd_docs(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(3, "word"), (3, "word"), (None, LINE), (None, None)] + [(100 + i, LINE) for i in range(6)]
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, 1, ["w"], 1, 2, "f", "d", 0.1, 3, "c", [1], 1, 1, 1) for i, t in rows], EXTRA)


@pytest.fixture(scope="module")
def chain(spark):
    return quality_crf.train(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"), 200)


@pytest.fixture(scope="module")
def net(spark):
    return toxicity_cnn.train(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"), 200)


@pytest.fixture(scope="module")
def vocabulary():
    return gumbel_pieces.load()


def both(spark):
    docs = odd_docs(spark)
    return [docs, docs.limit(0)]


def test_quality(spark, chain):
    for docs in both(spark):
        got = quality_crf.score(docs.drop("quality_score"), chain).collect()
        assert len(got) == docs.count() and all(0 <= r.quality_score <= 1 for r in got)
        assert {r.quality_lines for r in got if not r.text} <= {1}


def test_quality_and_toxicity_without_labels(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_crf.score(docs.select("doc_id", "text"), quality_crf.train(docs, labels), prefix="").collect()} == {0.5}
    assert {r.t for r in toxicity_cnn.score(docs.select("doc_id", "text"), toxicity_cnn.train(docs, labels), name="t").collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, None), (4, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_crf.score(docs.select("doc_id", "text"), quality_crf.train(docs, one), prefix="").collect()} == {1.0}


def test_toxicity(spark, net):
    for docs in both(spark):
        got = toxicity_cnn.score(docs, net).collect()
        assert len(got) == docs.count() and all(0 <= r.toxicity <= 1 for r in got)


def test_licenses(spark):
    for docs in both(spark):
        got = license_diagonals.scan(docs).collect()
        assert len(got) == docs.count() and all(r.score == 0 and r.labels == "" and r.first_word is None for r in got)


def test_lines(spark):
    docs = odd_docs(spark)
    got = line_mphf.drop_lines(docs.drop("dedup_text")).collect()
    assert len(got) == docs.count() and line_mphf.drop_lines(docs.limit(0).drop("dedup_text")).count() == 0
    dropped = {r.doc_id: r.dedup_dropped for r in got}
    assert dropped[5] == 1 and dropped[11] == 1 and dropped[105] == 0 and dropped[None] == 0
    assert {r.dedup_text for r in got if r.text is None} == {""}
    assert next(r for r in got if r.doc_id == 11).dedup_text == "line one\nline three"


def test_lines_by_groups_of_shards(spark):
    """Many shards and small groups give the same rows as one index."""
    docs = common.table(spark, SF, "documents").select("doc_id", "text")
    whole = line_mphf.drop_lines(docs, 10, 2)
    cut = line_mphf.drop_lines(docs, 10, 2, shard_keys=16, group_bytes=16 * 40 * 3)
    key = lambda df: sorted((r.doc_id, r.dedup_text, r.dedup_lines, r.dedup_dropped) for r in df.collect())
    assert key(whole) == key(cut) and any(r.dedup_dropped for r in whole.collect())


def test_near_duplicates(spark):
    docs = odd_docs(spark)
    got = simhash_bk.near_duplicates(docs).collect()
    assert len(got) == docs.count() and simhash_bk.near_duplicates(docs.limit(0)).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[100].component_id == by[105].component_id == 5 and by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == 0 and by[2].component_id == 0
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_decontamination(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, LINE.upper() + "!"), (2, None), (3, "too short"), (None, "one two three four five six seven"), (1, LINE), (4, "")], "item_id long, text string")
    got = spaced_decontam.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, 1) for d in (5, 11, None, *range(100, 106))} | {(4, None)}
    assert spaced_decontam.leaks(docs, items, slice_seeds=5).count() == len(got)
    assert spaced_decontam.leaks(docs.limit(0), items).count() == 0 == spaced_decontam.leaks(docs, items.limit(0)).count()
    assert spaced_decontam.clean(docs, items).columns == docs.columns
    assert spaced_decontam.clean(docs, items.limit(0)).count() == docs.count()
    assert spaced_decontam.clean(docs, items).count() == docs.count() - 10


def test_pieces(spark, vocabulary):
    for docs in both(spark):
        got = gumbel_pieces.encode(docs.drop("ids", "sample"), vocabulary).collect()
        assert all(r.decodes for r in got)
        assert len(got) >= docs.count() and (not got or {r.n_pieces for r in got if r.log_inclusion == 0 and r.n_pieces == 0} == {0})


def test_language(spark):
    model = langid_fusion.train(common.table(spark, SF, "documents"), 50)
    rows = [(1, None, None, "x"), (2, "http://a.b.example.com:80/x", "<html lang='de'>" + "der die das und " * 20, "x"), (2, "http://a.b.example.com/x", "", "x"), (None, "no address", "<p>the of and</p>", "x"), (5, "http://", "<", "x"), (6, "http://h/", "a " * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = langid_fusion.identify(pages, model).collect()
    assert len(got) == len(rows) and all(0 < r.confidence <= 1.0000001 and r.lang for r in got)
    assert langid_fusion.identify(pages.limit(0), model).count() == 0
    nothing = langid_fusion.identify(pages, langid_fusion.fit([])).collect()
    assert len(nothing) == len(rows) and all(r.lang is None for r in nothing)


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.FREE-bets.example.com?x"), (5, "x://q.net"), (6, "x://q.net/"), (7, "http://EXAMPLE.net/en/1#f"), (8, "http://www.example.com/de/?q"), (9, "a://b.org/fr/x"), (9, "a://b.org/fr/x"), (10, "http://bad.host/x://y"), (None, "http://sub.bad.host")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("bad.host",), ("absent.example",), (None,), ("bad.host",)], "key string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(pages, listed).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.free-bets.example.com", "", None, "allow"), (5, "q.net", "", None, "allow"), (6, "q.net", "/", "net/", "block"),
        (7, "example.net", "/en/1", "example.net/en/", "allow"), (8, "www.example.com", "/de/", "example.com/de/", "block"), (9, "b.org", "/fr/x", "org/fr/", "allow"), (9, "b.org", "/fr/x", "org/fr/", "allow"),
        (10, "bad.host", "/x://y", None, "block"), (None, "sub.bad.host", "", None, "block")], key=str)
    assert {r.verdict for r in url_cascade.judge(pages.where("page_id = 10"), listed.limit(0)).collect()} == {"allow"}
    assert url_cascade.judge(pages.limit(0), listed).count() == 0


def test_long_lists(spark):
    """A list of several cascades blocks the same pages."""
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.h"), F.col("id") % 100, F.lit(".example.com/x")).alias("url"))
    listed = spark.range(0, 100, 3).select(F.concat(F.lit("h"), "id", F.lit(".example.com")).alias("key"))
    got = {r.page_id for r in url_cascade.judge(pages, listed, max_listed=15).where("verdict = 'block'").collect()}
    assert got == {i for i in range(400) if i % 100 % 3 == 0}


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 20000, 97).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_cascade.cascade(universe, listed)
    got = {r.key for r in universe.where(url_cascade.member(levels, F.col("key"))).collect()}
    assert len(levels) > 1 and got == {r.key for r in listed.collect()}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, nan]), (6, [1.0, inf]), (7, [1.0, None]), (8, []), (9, [1.0, 1.0, 1.0]), (50, [0.0, 3.0]), (50, [0.0, 3.0]), (None, [1.0, 0.0]), (10, [1e-30, 1e-30]), (11, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann_tiles.nearest(v, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 10, 0.707107), (0, 4, 50, 0.0), (0, 5, 11, -1.0), (50, 1, 10, 0.707107), (50, 2, 0, 0.0), (50, 3, 1, 0.0), (50, 4, 2, 0.0), (50, 5, 11, 0.0)]
    assert ann_tiles.nearest(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    small = ann_tiles.nearest(v, F.col("vec_id") % 50 == 0, query_block=1, candidate_block=2, slice_bytes=1)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in small.collect()) == got


def test_stages(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    assert {0, 3, 5, None} <= kept and not kept & set(range(100, 106))
    assert corpus_pipeline.encoding_stage(spark, docs, SF).where("NOT decodes").count() == 0


def test_clashing_names_are_refused(spark, chain, net, vocabulary):
    docs = odd_docs(spark).limit(3)
    for call in (lambda d: quality_crf.score(d, chain), lambda d: toxicity_cnn.score(d, net, name="Score"), line_mphf.drop_lines, lambda d: gumbel_pieces.encode(d, vocabulary)):
        with pytest.raises(ValueError, match="rename"):
            call(docs)
