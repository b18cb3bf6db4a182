"""Goldens of public specimens, boundaries and rule cases."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import boxes, checkdigits, dates, mrz, payloads, text, vectors
from evidentia.operators import extract, registry, rules, scoring, similarity

TD3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C<3UTO6908061F9406236ZE184226B<<<<<14"]
TD2 = ["I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<", "D231458907UTO7408122F1204159<<<<<<<6"]
TD1 = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def parsed(spark, fmt, lines):
    return spark.createDataFrame([tuple(lines)], ", ".join(f"l{i} string" for i in range(len(lines)))).select(*(c.alias(n) for n, c in mrz.parse(fmt, [F.col(f"l{i}") for i in range(len(lines))]).items())).first()


def test_check_digits(spark):
    d = checkdigits.mrz_check_digit
    row = one(spark, d(F.lit("L898902C<")), d(F.lit("690806")), d(F.lit("940623")), d(F.lit("ZE184226B<<<<<")), d(F.lit("AB2134<<<")), d(F.lit("a!")), d(F.lit("")))
    assert list(row) == [3, 1, 6, 1, 5, None, 0]
    plain = lambda t: sum((int(c, 36) if c != "<" else 0) * (7, 3, 1)[i % 3] for i, c in enumerate(t)) % 10
    texts = ["Z" * n for n in range(1, 55)] + ["A1<B2<C3<D4<E5<F6" * 3, "9<" * 20]
    got = spark.createDataFrame([(t,) for t in [*texts, "A" * 55, "12 4", "-12", " 12"]], "t string").select("t", d(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == {t: plain(t) for t in texts} | {"A" * 55: None, "12 4": None, "-12": None, " 12": None}


def test_verhoeff(spark):
    v = checkdigits.verhoeff_valid
    row = one(spark, v(F.lit("2363")), v(F.lit("2364")), checkdigits.verhoeff_check_digit(F.lit("23456789012")), v(F.lit("234567890124")), v(F.lit("12x")), v(F.lit(None).cast("string")))
    assert list(row) == [True, False, "4", True, False, None]
    good = "234567890124"
    wrong = [good[:i] + str((int(good[i]) + 1) % 10) + good[i + 1 :] for i in range(12)]
    assert not any(r[0] for r in spark.createDataFrame([(w,) for w in wrong], "n string").select(v(F.col("n"))).collect())


@pytest.mark.parametrize(("fmt", "lines", "number"), [("TD3", TD3, "L898902C<"), ("TD2", TD2, "D23145890"), ("TD1", TD1, "D23145890")])
def test_specimens(spark, fmt, lines, number):
    r = parsed(spark, fmt, lines)
    assert r.recognised and r.document_number == number and (r.surname, r.given_names) == ("ERIKSSON", "ANNA MARIA")
    assert r.document_number_ok and r.birth_ok and r.expiry_ok and r.composite_ok


def test_tampering(spark):
    r = parsed(spark, "TD3", [TD3[0], TD3[1].replace("L898902C", "L898902D")])
    assert not r.document_number_ok and not r.composite_ok and r.birth_ok
    r = parsed(spark, "TD3", [TD3[0], TD3[1][:20] + "M" + TD3[1][21:]])
    assert r.composite_ok and r.sex == "M"
    r = parsed(spark, "TD3", [TD3[0], TD3[1][:-1] + "8"])
    assert not r.composite_ok
    for bad in (["SHORT_LINE", "ALSO_SHORT"], [TD3[0][:-1] + "ä", TD3[1]]):
        r = parsed(spark, "TD3", bad)
        assert r.recognised is False and r.surname is None


def test_names_and_centuries(spark):
    r = parsed(spark, "TD3", ["P<UTO" + "SINGLENESS".ljust(39, "<"), TD3[1]])
    assert (r.surname, r.given_names) == ("SINGLENESS", "")
    y = lambda yy, ref, past: mrz.century(F.lit(yy), ref, past)
    assert list(one(spark, y(69, 1970, False), y(30, 2026, False), y(30, 2026, True))) == [1969, 2030, 1930]
    assert list(one(spark, mrz.iso_date(F.lit("990231"), 2026, True), mrz.iso_date(F.lit("69080x"), 2026, True), mrz.iso_date(F.lit("690806"), 2026, True))) == [None, None, "1969-08-06"]


DATE_CASES = [
    ("1980-05-10", "2015-03-01", "2030-03-01", set()),
    ("1980-05-10", "2015-03-01", "2020-03-01", {"expired"}),
    ("1980-05-10", "2015-03-01", "2010-03-01", {"expired", "expiry_before_issue"}),
    ("2000-06-01", "1995-01-01", "2030-01-01", {"issue_before_birth"}),
    ("2035-06-01", "2020-01-01", "2030-01-01", {"dob_in_future", "issue_before_birth"}),
    ("1990-06-01", "2035-01-01", "2040-01-01", {"issue_in_future"}),
    ("1850-06-01", "2015-03-01", "2030-03-01", {"age_out_of_plausibility"}),
    (None, None, "2030-01-01", {"dob_missing", "issue_missing"}),
    ("not-a-date", None, None, {"invalid_date_format", "issue_missing", "expiry_missing"}),
    ("1990-01-01", "2026-01-01", "2026-01-01", set()),
]


def test_date_rules(spark):
    rows = spark.createDataFrame([(str(i), *c[:3]) for i, c in enumerate(DATE_CASES)], "doc_id string, birth string, issue string, expiry string")
    found = {}
    for r in rules.date_logic(rows, "2026-01-01").collect():
        found.setdefault(r.doc_id, set()).add(r.code)
    for i, c in enumerate(DATE_CASES):
        assert found.get(str(i), set()) == c[3], c
    assert one(spark, dates.age(F.lit("1980-05-10").cast("date"), F.lit("2026-01-01").cast("date")))[0] == 45
    assert one(spark, dates.parse(F.lit("5/8/1995")), dates.parse(F.lit("95-08-15")), dates.parse(F.lit("31/02/1995")))[1:] == (None, None)


def test_ledger_and_score(spark):
    flags = spark.createDataFrame([("a", i, c, s) for i, (c, s) in enumerate([("x", "high"), ("y", "warning"), ("z", "info"), ("v", "high"), ("w", "high")])], "doc_id string, seq int, code string, severity string")
    assert [(r.deduction, r.balance) for r in scoring.ledger(flags).orderBy("seq").collect()] == [(22, 78), (8, 70), (0, 70), (22, 48), (8, 40)]
    docs = spark.createDataFrame([("a", "passport"), ("b", "unknown")], "doc_id string, document_type string")
    fields = spark.createDataFrame([("a", 0.3), ("b", 0.9)], "doc_id string, confidence double")
    assert {r.doc_id: r.score for r in scoring.coherence(docs, flags, fields).collect()} == {"a": 38, "b": 75}


def test_blacklist_states(spark):
    rows = spark.createDataFrame([(1, "A", "X"), (2, "B", "X"), (3, "C", "X"), (4, "", None), (5, "D", "X")], "doc_id int, number string, surname string")
    listing = spark.createDataFrame([("A", "X", True), ("B", "X", None), ("C", "X", False)], "number string, surname string, listed boolean")
    got = {r.doc_id: (r.code, r.severity) for r in rules.blacklist(rows, listing).collect()}
    assert got == {1: ("blacklist_hit", "warning"), 2: ("blacklist_lookup_failed", "warning"), 3: ("blacklist_clear", "info"), 4: ("blacklist_no_identifiers", "info"), 5: ("blacklist_clear", "info")}
    assert {r.code for r in rules.blacklist(rows, None).collect()} == {"blacklist_not_configured"}
    # what both have must agree, and a null says nothing
    rows = spark.createDataFrame([(1, "A", None, None), (2, None, "Y", "G"), (3, "A", "Z", None), (4, None, "Y", "H"), (5, None, "W", None)], "doc_id int, number string, surname string, given_names string")
    listing = spark.createDataFrame([("A", "X", None, True), (None, "Y", "G", True), ("Q", "W", None, True)], "number string, surname string, given_names string, listed boolean")
    got = {r.doc_id: r.code.removeprefix("blacklist_") for r in rules.blacklist(rows, listing).collect()}
    assert got == {1: "hit", 2: "hit", 3: "number_listed", 4: "clear", 5: "hit"}


def test_a_lookup_that_raises(spark):
    """An exception is that row's failed look-up; the others of its task are answered."""

    def lookup(query):
        if query.get("number") == "boom":
            raise RuntimeError
        return {"A": True, "B": False}.get(query.get("number"))

    rows = spark.createDataFrame([(1, "A", "X"), (2, "B", "X"), (3, "boom", None), (4, " ", None), (5, "C", None)], "doc_id int, number string, surname string").coalesce(1)
    got = {r.doc_id: (r.code.removeprefix("blacklist_"), r.severity) for r in rules.blacklist_by(rows, lookup).collect()}
    assert got == {1: ("hit", "warning"), 2: ("clear", "info"), 3: ("lookup_failed", "warning"), 4: ("no_identifiers", "info"), 5: ("lookup_failed", "warning")}


def test_payloads(spark):
    import base64
    import zlib

    markup = b'<Q uid="012" name="A B" dob="01-01-1990"><signature>x</signature></Q>'
    rows = [(1, markup), (2, zlib.compress(markup)), (3, base64.b64encode(zlib.compress(markup))), (4, b"garbage"), (5, None), (6, b"<Q><uid>77</uid></Q>")]
    got = {r.k: r for r in payloads.decode_identity(spark.createDataFrame(rows, "k int, raw binary")).collect()}
    assert all(got[k].uid == "012" and got[k].signature_present and got[k].decoded for k in (1, 2, 3))
    assert not got[4].decoded and not got[5].decoded and got[6].uid == "77" and not got[6].signature_present
    long = spark.createDataFrame([(zlib.compress(b"<Q uid='1'>" + b"x" * payloads.MAX_BYTES),)], "raw binary")
    assert payloads.decode_identity(long).first().uid is None
    parts = payloads.decode_licence(F.col("p"))
    cases = {
        '{"DL_No":"UT01 2019 12345678","DOB":"1-1-1990","valid till":"02/03/2030"}': ("UT01201912345678", None, "1-1-1990", "02/03/2030"),
        "LIC UT01201912345678; NAME: X Y; DOB: 01-01-1990": ("UT01201912345678", None, "01-01-1990", None),
        "MH12 2005 0089012 15/08/1990": ("MH1220050089012", None, "15/08/1990", None), "mh1220050089012": ("MH1220050089012", None, None, None),
        '{"licenceNumber":"ZZ-77"}': ("ZZ-77", None, None, None), '{"drivingLicence":"mh12 20050089012","Holder Name":"a b"}': ("MH1220050089012", "A B", None, None),
        '{"dlno":" ","name":""}': (None, None, None, None), "nothing": (None, None, None, None), "{broken 1/2/1999": (None, None, "1/2/1999", None),
    }
    got = spark.createDataFrame([(c,) for c in cases], "p string").select("p", *(parts[n].alias(n) for n in ("number", "name", "birth", "expiry"))).collect()
    assert {r.p: tuple(r)[1:] for r in got} == cases


def test_text_and_vectors(spark):
    assert list(one(spark, text.gender(F.lit(" male ")), text.gender(F.lit("x")), text.number_fits(F.lit("passport"), F.lit("L898902C<")), text.number_fits(F.lit("unknown"), F.lit("?")))) == ["MALE", None, True, None]
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert list(one(spark, vectors.cosine(a, a), vectors.cosine(a, b), vectors.cosine(a, F.array(F.lit(1.0))), vectors.distance(a, b))) == [1.0, 0.0, None, 1.0]
    m = lambda **k: F.create_map(*(F.lit(x) for p in k.items() for x in p))
    assert list(one(spark, vectors.factor_similarity(m(x=1.0, y=0.5), m(x=0.5)), vectors.factor_similarity(m(x=1.0), m(y=1.0)))) == [0.5, None]
    assert one(spark, boxes.crop_name(F.lit("a b/c.d")))[0] == "a_b_c_d"


def test_mrz_block(spark):
    rows = [("a", 0, "NOISE"), ("a", 1, TD3[0]), ("a", 2, TD3[1]), ("a", 3, "more noise"), ("b", 0, TD3[0].rstrip("<")), ("b", 1, TD3[1]), ("c", 0, "PXX"), ("d", 0, TD1[0]), ("d", 1, TD1[1]), ("d", 2, TD1[2])]
    got = {r.doc_id: r for r in extract.mrz_block(spark.createDataFrame(rows, "doc_id string, line_no int, text string")).collect()}
    assert got["a"].fmt == "TD3" and not got["a"].relaxed and got["a"].line_no == 1
    assert got["d"].fmt == "TD1" and "c" not in got
    # blank lines don't count, noise does; formats come before lines, whole lines before padded ones
    cases = {
        "blank": [TD3[0], " ", None, TD3[1]], "noise": [TD3[0], "x-ray", TD3[1]], "spaced": ["", TD3[0].lower().replace("<ANNA", "< ANNA"), TD3[1]],
        "order": [*TD1, *TD3], "whole": [TD3[0][:-2], TD3[1], *TD2], "other letter": ["X" + TD2[0][1:], TD2[1]], "odd": [TD2[0][:-1] + "?", TD2[1]], "short": [TD2[0][:20], TD2[1]],
    }
    rows = [(d, k, x) for d, texts in cases.items() for k, x in enumerate(texts)]
    got = {r.doc_id: (r.fmt, r.line_no, r.relaxed, r.l2) for r in extract.mrz_block(spark.createDataFrame(rows, "doc_id string, line_no int, text string")).collect()}
    assert got == {"blank": ("TD3", 0, False, TD3[1]), "spaced": ("TD3", 1, False, TD3[1]), "order": ("TD3", 3, False, TD3[1]), "whole": ("TD2", 2, False, TD2[1]), "other letter": ("TD2", 0, False, TD2[1])}


def test_registry(spark):
    docs = spark.createDataFrame([(1, 10, 7), (2, 11, 7), (3, 12, None)], "document_number int, identity_id int, family_id int")
    people = spark.createDataFrame([(10,), (11,), (12,)], "identity_id int")
    assert {tuple(r) for r in registry.clusters(people, docs).collect()} == {(10, 10), (10, 11), (11, 10), (11, 11), (12, 12)}
    events = spark.createDataFrame([(1, 11, "A", "HIGH"), (2, 11, "B", "LOW")], "event_id int, identity_id int, checkpoint string, risk_level string")
    got = {r.identity_id: r for r in registry.cluster_alerts(people, docs, events).collect()}
    assert got[10].alert and got[10].total_checkpoints == 2 and not got[12].alert and got[12].total_appearances == 0


def test_best_and_threshold_matches(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "identity_id int, vec array<double>")
    q = v.selectExpr("identity_id AS query_id", "vec AS query_vec")
    assert similarity.best_match(q, v, 0.1).where("distance = 0").count() == 6
    assert similarity.threshold_matches(q, v.where("identity_id > 3"), 0.5).where("known_id = 'unknown'").count() == 4


def test_recogniser(spark):
    lines = {
        1: ["UIDAI", "Asha Devi Rao", "DOB", "PHOTO", "01/02/1990", "MALE", "Your Aadhaar Number", "9012", "0000", "3456"],
        2: ["Permanent Account Number: ABCDE1234F", "Name", "", "JOHN ROE"],
        3: ["DL No UT01 20110012345", "licence no: UT0120110012345", "Document No", "x", "1234 5678 9012"],
        4: ["Government of Somewhere", "Valid till", "DOB", "1985"],
    }
    rows = [(d, k, t, 0.5 + 0.1 * (k == 1), {7: 0.5, 8: 0.9, 9: 0.1}.get(k, 0.0)) for d, ls in lines.items() for k, t in enumerate(ls)]
    got = {}
    for r in extract.recognise(spark.createDataFrame(rows, "doc_id int, line_no int, text string, confidence double, x double")).collect():
        got.setdefault(r.doc_id, {})[r.name] = r.value
    assert got[1] == {"surname": "Asha Devi Rao", "date_of_birth": "01/02/1990", "sex": "MALE", "document_number": "345690120000"}
    assert got[2] == {"document_number": "ABCDE1234F"}
    assert got[3] == {"document_number": "UT0120110012345"}
    assert got[4] == {"date_of_birth": "1985"}
