"""A labelled document that repeats takes one place of the sample, so that it pushes no other out."""

from evidentia.llm import common


def test_repeated_ids_push_nothing_out(spark):
    rows = [(0, f"copy {k % 3}") for k in range(500)] + [(k, f"text {k}") for k in range(1, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, quality int")
    got = common.labelled_sample(docs, labels, "quality", 4, 9, 20, 100)
    assert sorted(r["doc_id"] for r in got) == list(range(10))
    assert {r["label"] for r in got} == {0, 1}
    again = common.labelled_sample(docs.repartition(3), labels, "quality", 4, 9, 20, 100)
    assert got == again
