"""Every language of the documents is answered, however many there are and however long their documents."""

import hashlib

import pytest

from evidentia.llm import langid_fusion


def _docs(spark, n, long=()):
    word = lambda k: "".join(chr(97 + b % 26) for b in hashlib.sha256(b"%d" % k).digest()[:12])
    rows = [(k * 10 + i, f"{word(k)} {word(k + 1000)} " * (1000 if k in long else 20), f"l{k:03}") for k in range(n) for i in range(2 if k else 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)


def test_no_language_is_dropped(spark):
    docs = _docs(spark, 70)
    model = langid_fusion.train(docs)
    assert model.languages == [f"l{k:03}" for k in range(70)]
    for r in docs.collect():
        assert model.languages[model.of(r.text.encode())[0].argmax()] == r.lang


def test_a_language_of_long_documents_stays(spark):
    assert langid_fusion.train(_docs(spark, 3, long={1})).languages == ["l000", "l001", "l002"]


def test_letters_far_behind_count(spark):
    rows = [(1, "1 " * 9000 + "late letters", "a"), (2, "other words here", "b"), (3, "12 34", "c")]
    model = langid_fusion.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["a", "b"] and model.languages[model.of(b"late letters")[0].argmax()] == "a"


def test_repeated_ids_take_one_place(spark):
    rows = [(0, "same words here", "a")] * 50 + [(k, f"other word{chr(97 + k)}", "a") for k in range(1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = langid_fusion.train(docs.dropDuplicates())
    assert (langid_fusion.train(docs, rows=5).table == want.table).all()


def test_too_many_languages_stop(spark, monkeypatch):
    monkeypatch.setattr(langid_fusion, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid_fusion.train(_docs(spark, 3))
