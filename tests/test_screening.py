"""The screening plan searches every identity that has a vector."""

import json

import duckdb
import numpy as np

from evidentia import catalogue
from evidentia.plans import oracle, screening
from evidentia.sources import domain

from test_catalogue import SF


def test_every_identity_with_a_vector_is_searched(spark):
    held = {r.identity_id: r.embedding for r in domain.identities(spark, SF).where("embedding IS NOT NULL").select("identity_id", "embedding").collect()}
    ids = sorted(held)
    v = np.array([held[i] for i in ids], float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    near = v @ v.T
    np.fill_diagonal(near, -1)
    want = {i: min(3, int(n)) for i, n in zip(ids, (near >= screening.SHOW).sum(1))}
    rows = screening.risk_rows(spark, SF).select("identity_id", "identity_matches", "f_identity").collect()
    assert {r.identity_id: r.identity_matches for r in rows} == {r.identity_id: want.get(r.identity_id, 0) for r in rows}
    assert all(r.f_identity == (20 if want.get(r.identity_id) else 0) for r in rows)
    assert {i % 10 for i in want} == set(range(10))


def faces():
    """identity_id: face factor of every customer, by the pseudo-embeddings of name and nationality."""
    c = duckdb.connect()
    for t in ("customer", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return {i: round(0.0 if s >= 0.72 else 10 * (1 - s), 6) for i, s in c.execute(f"WITH {oracle.FACES[2:]} SELECT identity_id, round(s, 6) FROM face").fetchall()}


def test_every_identity_has_a_face_factor(spark):
    got = {r.identity_id: r.f_face for r in catalogue.queries()["risk_factors"](spark, SF).select("identity_id", "f_face").collect()}
    want = faces()
    assert got.keys() == want.keys() and len(set(got.values())) > 2 and all(abs(got[i] - want[i]) < 2e-5 for i in want)


def totals(spark):
    """identity_id: risk score as the sum of the factors, the face's among them."""
    rows = catalogue.queries()["risk_factors"](spark, SF).collect()
    return {r.identity_id: round(min(100.0, round(sum(x or 0 for x in r[1:]), 6))) for r in rows}


def test_the_score_has_the_face_factor(spark):
    assert {r.identity_id: r.risk_score for r in catalogue.queries()["risk_score_band"](spark, SF).collect()} == totals(spark)


def test_records_have_the_score_with_the_face_factor(spark):
    records = [json.loads(r.result_json) for r in catalogue.queries()["verification_records"](spark, SF).collect()]
    assert {r["identity_id"]: r["risk_score"] for r in records} == totals(spark)


def test_the_log_has_the_score_with_the_face_factor(spark):
    lines = catalogue.queries()["screening_log"](spark, SF).collect()
    assert {r.verification_id: int(r.line.split("risk_score=")[1].split()[0]) for r in lines} == totals(spark)
