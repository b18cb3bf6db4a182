"""From lines to score in one plan: hand-made documents, and the balance of every ledger."""

import random

from pyspark.sql import functions as F

from evidentia import catalogue
from evidentia.operators import intake, layout, validate

from test_catalogue import SF
from test_functions import TD3


def test_documents(spark):
    lines = {
        "zone": ["PASSPORT", *TD3, "DOB: 13/08/1974"],
        "blank": [" "],
        "uid": ["UIDAI", "Asha Devi Rao", "DOB: 01/02/1990", "MALE", "0000 0000 0001"],
        "like": ["P<UTOSOMEONE<<WITH<A<LINE<THAT<ENDS", "something else"],
        "lost": ["PASSPORT"],
    }
    rows = [(d, k, t, 0.3 if t.startswith("DOB") else 0.9) for d, ls in lines.items() for k, t in enumerate(ls)]
    docs = [("zone", "front", None, False), ("blank", None, None, False), ("uid", "back", None, False), ("like", None, "pan_card", False), ("lost", None, None, True), ("none", None, None, False)]
    codes = [("uid", 0, "aadhaar_qr", "uid", "000000000001"), ("uid", 0, "aadhaar_qr", "name", "RAO DEVI ASHA"), ("uid", 0, "aadhaar_qr", "dob", "1990-02-02")]
    got = validate.validate_lines(spark.createDataFrame(rows, "doc_id string, line_no int, text string, confidence double"), "2026-01-01", spark.createDataFrame(docs, "doc_id string, side string, forced_type string, unreadable boolean"), spark.createDataFrame(codes, "doc_id string, seq int, channel string, name string, value string"))
    flags = {}
    for r in got.flags.orderBy("doc_id", "seq").collect():
        flags.setdefault(r.doc_id, []).append(r.code)
    fields = {(r.doc_id, r.name): (r.value, r.source) for r in got.fields.collect()}
    results = {r.doc_id: r for r in got.results.collect()}
    assert results.keys() == {d[0] for d in docs}
    assert results["zone"].document_type == "passport" and results["zone"].mrz_found and fields["zone", "date_of_birth"] == ("13/08/1974", "visual") and fields["zone", "surname"][1] == "mrz"
    assert flags["zone"][0] == "ocr_read_from" and "cross_source_date_mismatch" in flags["zone"] and "mrz_checks_verified" in flags["zone"] and flags["zone"].index("expired") < flags["zone"].index("mrz_checks_verified")
    assert "secure_anchor_missing" not in flags["zone"]
    assert flags["blank"][0] == flags["none"][0] == "ocr_no_text" and results["none"].document_type == "unknown"
    assert results["uid"].document_type == "aadhaar" and {"machine_channel_read", "aadhaar_checksum_failed", "aadhaar_qr_checksum_failed", "aadhaar_qr_dob_mismatch", "aadhaar_qr_name_match"} <= set(flags["uid"]) and "anchor_crop_hint" not in flags["uid"]
    assert "mrz_detection_failed" in flags["like"] and results["like"].document_type == "pan_card" and results["like"].classification_confidence == 1
    assert flags["lost"] == ["image_preprocessing_failed"] and results["lost"].score == 0 and results["lost"].document_type == "unknown"
    assert all(c[-1] == "blacklist_not_configured" for d, c in flags.items() if d != "lost")
    ledger = [r for r in got.ledger.orderBy("seq").collect() if r.doc_id == "zone"]
    assert [r.code for r in ledger[-2:]] == ["low_ocr_confidence", "remaining_points"] and ledger[-1].balance == results["zone"].score


def test_a_forged_licence(spark):
    """Codes as a reader gives them, through the channels into the rules: another number and birth date in print than in the barcode."""
    rows = [("forged", 0, "DRIVING LICENCE"), ("forged", 1, "Licence No: UT0220190000002"), ("forged", 2, "DOB: 05/06/1991"), ("sound", 0, "DRIVING LICENCE"), ("sound", 1, "Licence No: UT0120190000001"), ("sound", 2, "DOB: 01/02/1990"), ("code", 0, "DRIVING LICENCE")]
    text = '{"licenceNo": "ut01 2019 0000001", "dob": "01-02-1990", "holdername": "Some One", "validTill": "01-02-2030"}'
    decodes = spark.createDataFrame([(d, 0, "PDF417", text, None) for d in ("forged", "sound", "code")], "doc_id string, seq int, format string, text string, raw binary")
    got = validate.validate_lines(spark.createDataFrame(rows, "doc_id string, line_no int, text string"), "2026-01-01", None, intake.barcode_parts(intake.barcode_channels(decodes)))
    flags = {}
    for r in got.flags.collect():
        flags.setdefault(r.doc_id, set()).add(r.code)
    wrong = {"dl_barcode_number_mismatch", "dl_barcode_dob_mismatch"}
    assert wrong <= flags["forged"] and not wrong & (flags["sound"] | flags["code"]) and all("machine_channel_read" in f and "secure_anchor_missing" not in f for f in flags.values())
    fields = {(r.doc_id, r.name): (r.value, r.source) for r in got.fields.collect()}
    assert fields["forged", "surname"] == ("SOME ONE", "barcode") and fields["code", "document_number"] == ("UT0120190000001", "barcode") and fields["code", "date_of_expiry"][0] == "01-02-2030"
    assert not any(r.field == "surname" for r in got.flags.where("code = 'missing_required_field'").collect())


def test_boxes_and_companion(spark):
    """A surer line in a template's box replaces what may be replaced; other fields are only filled in."""
    rows = [
        ("pan", 0, "INCOME TAX PAN CARD", 0.9, 0.1, 0.05, 0.6, 0.10), ("pan", 1, "ABCDE1234F", 0.4, 0.35, 0.1, 0.6, 0.15), ("pan", 2, "abcde1239f x", 0.8, 0.35, 0.30, 0.6, 0.36),
        ("pan", 3, "PERSON NAME", 0.9, 0.5, 0.54, 0.8, 0.60), ("pan", 4, "ELSEWHERE", 0.99, 0.5, 0.40, 0.8, 0.56), ("pan", 5, "on 02/03/1990", 0.7, 0.5, 0.81, 0.7, 0.87),
    ]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    docs = spark.createDataFrame([("pan", None, True, False), ("other", None, None, False)], "doc_id string, forced_type string, companion_unreadable boolean, template_failed boolean")
    got = validate.validate_lines(lines, "2026-01-01", docs)
    fields = {r.name: (r.value, r.source) for r in got.fields.collect()}
    assert fields["document_number"] == ("ABCDE1239FX", "template") and fields["surname"] == ("PERSON NAME", "template") and fields["date_of_birth"] == ("02/03/1990", "template")
    flags = [r.code for r in got.flags.where("doc_id = 'pan'").orderBy("seq").collect()]
    assert flags[0] == "companion_image_preprocessing_failed" and "template_roi_applied" in flags
    failed = validate.validate_lines(lines, "2026-01-01", docs.withColumn("template_failed", F.lit(True)))
    assert {r.source for r in failed.fields.collect()} == {"visual"} and "template_roi_failed" in {r.code for r in failed.flags.collect()}


def test_box_join_has_each_pair_once(spark):
    rng = random.Random(2)
    box = lambda: (lambda x, y: (x, y, x + rng.uniform(0, 0.5), y + rng.uniform(0, 0.5)))(rng.uniform(-0.1, 0.9), rng.uniform(-0.1, 0.9))
    left, right = [(i, i % 2, *box()) for i in range(60)], [(i, i % 2, *box()) for i in range(40)]
    schema = "{} int, key int, x0 double, y0 double, x1 double, y1 double"
    got = layout.box_join(spark.createDataFrame(left + [(99, 0, 0.5, 0.5, 0.5, 0.9), (98, 0, None, 0.0, 1.0, 1.0)], schema.format("a")), spark.createDataFrame(right, schema.format("b")), ["key"], 5)
    want = {}
    for a, k, *p in left:
        for b, j, *q in right:
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            if k == j and w > 0 and h > 0:
                want[a, b] = w * h / ((p[2] - p[0]) * (p[3] - p[1]))
    rows = got.collect()
    assert len(rows) == len(want) and all(abs(want[r.a, r.b] - r.share) < 1e-9 for r in rows)


def test_every_ledger_ends_at_the_score(spark):
    queries = catalogue.queries()
    scores = {r.doc_id: r.score for r in queries["document_validation"](spark, SF).collect()}
    rows = {}
    for r in queries["document_ledger"](spark, SF).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(scores) > len(rows) > 0
    for d, ledger in rows.items():
        ledger.sort(key=lambda r: r.seq)
        balance = 100.0
        for r in ledger[:-1]:
            balance -= r.deduction
            assert r.balance == balance
        assert ledger[-1].code == "remaining_points" and round(ledger[-1].balance) == scores[d]
    assert len({*scores.values()}) > 3
