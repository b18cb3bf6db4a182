"""Logs that replays don't change, and readers that turn what is broken into rows."""

from pyspark.sql import functions as F

from evidentia.operators import registry
from evidentia.sources import quarantine
from evidentia.streaming import batchlog

DECISION = "verification_id string, decision string, at timestamp, decision_id long"


def rows_of(spark, *rows):
    return spark.createDataFrame([(v, d, None, n) for v, d, n in rows], DECISION).withColumn("at", F.timestamp_seconds("decision_id"))


def test_decisions_exactly_once(spark, tmp_path):
    records = spark.createDataFrame([("a",), ("b",)], "verification_id string")
    log, rejected = batchlog.BatchLog(spark, str(tmp_path / "log")), batchlog.BatchLog(spark, str(tmp_path / "rejected"))
    assert log.read() is None
    batches = [rows_of(spark, ("a", "DENIED", 1), ("x", "DENIED", 2), ("a", "DENIED", 1)), rows_of(spark, ("b", "CLEARED", 3), ("b", "MAYBE", 4)), rows_of(spark, ("a", "CLEARED", 5))]
    for n, rows in enumerate(batches):
        batchlog.decide(rows, records, log, rejected, n)
    state = lambda: sorted((r.verification_id, r.decision, r.decision_id, r.batch) for r in log.read().collect())
    want = [("a", "CLEARED", 5, 2), ("a", "DENIED", 1, 0), ("b", "CLEARED", 3, 1)]
    assert state() == want and {(r.decision_id, r.why) for r in rejected.read().collect()} == {(2, "no such record"), (4, "no such decision")}
    for n, rows in enumerate(batches):  # replayed, also with other rows
        batchlog.decide(rows, records, log, rejected, n)
        assert not log.write(batches[0], n)
    assert state() == want
    # a batch that broke off has no mark of success: it isn't read, and its replay writes it anew
    rows_of(spark, ("b", "DENIED", 9)).withColumn("batch", F.lit(3).cast("long")).write.parquet(str(tmp_path / "log/gen=0/batch=3"))
    (tmp_path / "log/gen=0/batch=3/_SUCCESS").unlink()
    assert state() == want
    assert log.write(rows_of(spark, ("b", "DENIED", 8)), 3)
    log.compact()
    again = batchlog.BatchLog(spark, str(tmp_path / "log"))
    assert [n for n in again._parts()[1]] == [] and again._parts()[2] == 3
    assert not again.write(batches[0], 1) and again.write(rows_of(spark, ("a", "DENIED", 10)), 4)
    assert sorted((r.decision_id, r.batch) for r in again.read().collect()) == [(1, 0), (3, 1), (5, 2), (8, 3), (10, 4)]
    got = {r.verification_id: (r.decision, r.n_decisions) for r in registry.latest_decisions(records, again.read()).collect()}
    assert got == {"a": ("DENIED", 3), "b": ("DENIED", 2)}


def test_a_stream_into_the_log(spark, tmp_path):
    """The same source read twice from the start, as after a lost checkpoint: its batches are in the log already."""
    records = spark.createDataFrame([("a",)], "verification_id string")
    log, rejected = batchlog.BatchLog(spark, str(tmp_path / "log")), batchlog.BatchLog(spark, str(tmp_path / "no"))
    for n in range(3):
        rows_of(spark, ("a", "CLEARED", n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for state in ("s1", "s2"):
        stream = spark.readStream.schema(DECISION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(lambda rows, n: batchlog.decide(rows, records, log, rejected, n)).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(r.decision_id for r in log.read().collect()) == [0, 1, 2]


def test_quarantine(spark, tmp_path):
    """Wrong magic, bad JSON and truncated Parquet in one run: rows with a reason, and degraded results."""
    up, js, pq = (tmp_path / n for n in ("up", "js", "pq"))
    for d in (up, js, pq):
        d.mkdir()
    (up / "d1.png").write_bytes(b"\x89PNGrest")
    (up / "d2.png").write_bytes(b"GIF89a")
    (js / "part.json").write_text('{"doc_id": "d3", "score": 90}\n{"doc_id": "d4", "score": "x"}\n{broken\n{"score": 3}\n')
    schema = "doc_id string, score int"
    spark.createDataFrame([("d5", 70), (None, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part-*.parquet")).read_bytes()
    (pq / "good.parquet").write_bytes(data)
    (pq / "d6.parquet").write_bytes(data[:-20])
    (pq / "d7.parquet").write_bytes(b"PAR1")
    (pq / "d8.parquet").write_bytes(b"PAR1" + b"\xff" * (len(data) - 12) + data[-8:])
    read = [quarantine.uploads(spark, str(up)), quarantine.json_records(spark, str(js), schema), quarantine.parquet_records(spark, str(pq), schema)]
    docs = spark.createDataFrame([(f"d{n}", "passport") for n in range(1, 7)], "doc_id string, document_type string")
    results = read[1][0].unionByName(read[2][0]).withColumn("document_type", F.lit("passport"))
    settled, letters = quarantine.settle([r for _, r in read], docs, results)
    got = {(r.doc_id, r.reason.split(":")[0]) for r in letters.collect()}
    assert got == {("d2", "upload"), ("d4", "json"), ("part", "json"), ("d6", "parquet"), ("d7", "parquet"), ("d8", "parquet"), ("good", "parquet")}
    assert {r.raw for r in letters.where("reason LIKE 'json%'").collect()} == {'{"doc_id": "d4", "score": "x"}', "{broken", '{"score": 3}'}
    assert {r.doc_id: (r.score, r.degraded) for r in settled.collect()} == {"d1": (0, True), "d2": (0, True), "d3": (90, False), "d4": (0, True), "d5": (70, False), "d6": (0, True), "d7": (0, True), "d8": (0, True), "part": (0, True), "good": (0, True)}
