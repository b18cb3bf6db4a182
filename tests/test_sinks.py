from pyspark.sql import functions as F

from evidentia.functions import boxes
from evidentia.sources import sinks


def test_append_and_decide(spark, tmp_path):
    path = str(tmp_path / "decisions")
    results = spark.createDataFrame([(1, 40, "MEDIUM"), (2, 80, "HIGH")], "identity_id long, risk_score int, risk_level string")
    records = sinks.verification_records(results, "identity_id", "2026-01-01")
    again = sinks.verification_records(results, "identity_id", "2026-01-01")
    ids = [r.verification_id for r in records.orderBy("subject").collect()]
    assert ids == [r.verification_id for r in again.orderBy("subject").collect()] and all(len(i) == 68 for i in ids)
    assert sinks.append_decision(spark, path, records, ids[0], "DENIED", "2026-01-02", 1)
    assert sinks.append_decision(spark, path, records, ids[0], "CLEARED", "2026-01-03", 2)
    assert not sinks.append_decision(spark, path, records, "VER-0", "CLEARED", "2026-01-03", 3)
    from evidentia.operators import registry

    got = {r.verification_id: (r.decision, r.n_decisions) for r in registry.latest_decisions(records, spark.read.parquet(path)).collect()}
    assert got == {ids[0]: ("CLEARED", 2), ids[1]: (None, 0)}
    sinks.append_audit(results, "identity_id", "risk_level", str(tmp_path / "audit"))
    assert {len(r.document_hash) for r in spark.read.parquet(str(tmp_path / "audit")).collect()} == {64}
    sinks.append_case(spark, str(tmp_path / "cases"), "D1", "altered", ["font"], "o1", None, "2026-01-01")
    assert spark.read.parquet(str(tmp_path / "cases")).first().detected_features == ["font"]


def test_seed_once(spark, tmp_path):
    path = str(tmp_path / "seed")
    assert sinks.seed_if_empty(spark, path, [(1,)], "x int").count() == 1
    assert sinks.seed_if_empty(spark, path, [(1,), (2,)], "x int").count() == 1


def test_pictures_and_uploads(spark, tmp_path):
    (tmp_path / "a b.JPG").write_bytes(b"\xff\xd8\xff\xe0rest")
    (tmp_path / "c.png").write_bytes(b"\x89PNGrest")
    (tmp_path / "d.txt").write_bytes(b"text")
    pictures = sinks.picture_files(spark, str(tmp_path))
    assert {r.stem for r in pictures.collect()} == {"a_b", "c"}
    verdicts = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.verdict for r in boxes.read_uploads(spark, str(tmp_path)).collect()}
    assert verdicts == {"a b.JPG": "ok", "c.png": "ok", "d.txt": "unsupported"}
    faces = pictures.select("path", F.lit(0).alias("face_no"), F.array(F.lit(1.0)).alias("vec"))
    assert sinks.known_people(pictures, faces.where("path LIKE '%JPG'")).count() == 1
