"""Intake operators by hand: pooled sides, decodes, cleaners, zones of any format, logs and self-tests."""

from pyspark.sql import functions as F

from evidentia.functions import boxes, mrz, text
from evidentia.operators import intake, registry
from evidentia.sources import sinks


def test_lines_of_files_and_sides(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n")
    (tmp_path / "empty.txt").write_text("")
    lines = intake.read_lines(spark, str(tmp_path))
    assert [(r.line_no, r.text) for r in lines.orderBy("line_no").collect()] == [(0, "one"), (1, "two")]
    schema = "doc_id long, line_no int, text string"
    front, back = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], schema), spark.createDataFrame([(1, 0, "c"), (2, 5, "d")], schema)
    pooled = intake.pool_sides(front, back).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line_no, r.side, r.text) for r in pooled] == [(1, 0, "front", "a"), (1, 1, "front", "b"), (1, 2, "back", "c"), (2, 0, "back", "d")]


def test_decodes_once_and_first_value_wins(spark):
    payload = '<QPDA uid="{}" name="{}" gender="M"/>'
    rows = [(1, 0, "QRCODE", payload.format("1", ""), None), (1, 1, "QRCODE", payload.format("1", ""), None), (1, 2, "QRCODE", payload.format("2", "B C"), None), (1, 3, "EAN13", None, None), (1, 4, "QRCODE", "", None)]
    codes = intake.barcode_channels(spark.createDataFrame(rows, "doc_id long, seq int, format string, text string, raw binary"))
    assert sorted((r.seq, r.channel, r.first_of_channel) for r in codes.collect()) == [(0, "aadhaar_qr", True), (2, "aadhaar_qr", False), (3, "unclassified", True), (4, "unclassified", False)]
    assert {(r.name, r.value) for r in intake.barcode_fields(intake.barcode_parts(codes)).collect()} == {("document_number", "1"), ("surname", "B C"), ("sex", "M")}


def test_licence_by_any_key(spark):
    text = '{"Licence-No": "UT01 20190000001", "DOB": "", "dob": "1/2/1990", "Valid Till": "3/4/2031", "holder_name": "A B"}'
    codes = intake.barcode_channels(spark.createDataFrame([(1, 0, "PDF417", text, None), (2, 0, "PDF417", "{broken", None)], "doc_id long, seq int, format string, text string, raw binary"))
    found = {(r.doc_id, r.name, r.value) for r in intake.barcode_fields(intake.barcode_parts(codes)).collect()}
    assert found == {(1, "document_number", "UT0120190000001"), (1, "surname", "A B"), (1, "date_of_birth", "1/2/1990"), (1, "date_of_expiry", "3/4/2031")}


def test_zone_of_any_lines(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, "", "ABC"]), (4, ["<" * 44, "é" * 44])], "k int, lines array<string>")
    found = {r.k: (r.format, r.recognised, r.message) for r in rows.select("k", *(c.alias(n) for n, c in mrz.parse_any(F.col("lines")).items())).collect()}
    assert found[2] == found[3] == (None, False, "unknown line lengths")
    assert found[1] == (None, False, "unknown line lengths") and found[4] == ("TD3", False, "characters of line 2")


def test_cleaners_and_signals(spark):
    row = spark.range(1).select(
        text.alphanumeric(F.lit("ab-1 é")).alias("n"), text.date_token(F.lit("x 1/2/99 y")).alias("d"), text.sex_token(F.lit(" ?? ")).alias("s"),
        text.percent(F.lit(0.125)).alias("p"), intake.byte_bias(F.lit("").cast("binary")).alias("b"), intake.byte_bias(F.lit("c" * 100).cast("binary")).alias("c"),
        text.date_token(F.lit(None).cast("string")).alias("z"),
    ).first()
    assert tuple(row) == ("AB1", "1/2/99", "??", "12%", 0.0, 64 * 99 % 100 / 100, None)


def test_own_graph_only(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "identity_id long")
    documents = spark.createDataFrame([(10, 1, 7), (20, 2, 7), (30, 3, None), (40, 9, 7)], "document_number long, identity_id long, family_id long")
    events = spark.createDataFrame([(1, "A"), (2, "B")], "identity_id long, checkpoint string")
    families = spark.createDataFrame([(7, "p")], "family_id long, common_pattern string")
    given = spark.createDataFrame([(1,), (1,), (8,)], "identity_id long")
    found = {(r.src, r.dst) for r in registry.graph_neighbourhood(given, people, documents, families, events).collect()}
    assert found == {("document:10", "person:1"), ("document:10", "pattern:7"), ("document:20", "pattern:7"), ("document:40", "pattern:7"), ("document:20", "person:2"), ("checkpoint:A", "person:1")}


def test_self_tests_and_named_files(spark, tmp_path):
    path = str(tmp_path / "tests")
    sinks.append_self_test(spark, path, "blur", True, 69.9, "2026-01-01 00:00:00")
    sinks.append_self_test(spark, path, "paste", True, 70.0, "2026-01-02 00:00:00")
    assert [(r.manipulation_type, r.correct) for r in sinks.self_test_history(spark, path).collect()] == [("paste", True), ("blur", False)]
    files = spark.createDataFrame([("file:/x/a.png",), ("file:/x/b.png",)], "path string")
    assert boxes.upload_named(files, "a.png").count() == 1 and boxes.upload_named(files, "x/a.png").count() == 0
