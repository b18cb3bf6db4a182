"""SQL functions against the column functions of their names, and the recogniser as a table function."""

from pyspark.sql import functions as F

from evidentia.functions import checkdigits, mrz, sqlapi, text
from evidentia.operators import extract


def test_scalar_functions(spark):
    assert len(sqlapi.register(spark)) == len(sqlapi.FUNCTIONS)
    texts = ["", "L898902C<", "690806", "a!", "234567890124", "23456789012x", "Z" * 54, "Z" * 55, " male ", "fmale", "Doe-Jane X", "990231", "12 34<", None]
    rows = spark.createDataFrame([(t, i % 2 == 0) for i, t in enumerate(texts)], "t string, past boolean")
    t = F.col("t")
    forms = {
        "mrz_check_digit(t)": checkdigits.mrz_check_digit(t), "verhoeff_valid(t)": checkdigits.verhoeff_valid(t), "digits(t)": text.digits(t), "cleaned_number(t)": text.cleaned_number(t),
        "alphanumeric(t)": text.alphanumeric(t), "name_words(t)": text.name_words(t), "gender(t)": text.gender(t), "iso_date(t, 2026, true)": mrz.iso_date(t, 2026, True), "iso_date(t, 2026, false)": mrz.iso_date(t, 2026, False),
    }
    rows.createOrReplaceTempView("rows_of_texts")
    said = spark.sql("SELECT t, " + ", ".join(f"{f} AS c{k}" for k, f in enumerate(forms)) + " FROM rows_of_texts").collect()
    want = rows.select("t", *(c.alias(f"c{k}") for k, c in enumerate(forms.values()))).collect()
    assert sorted(map(str, said)) == sorted(map(str, want)) and any(r.c1 for r in said)


def test_recogniser_as_a_table_function(spark):
    rows = [(1, 0, "Name: SOME ONE"), (1, 1, "DOB: 01/02/1990"), (2, 0, "Document No: AB12345"), (3, 0, "nothing")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, text string")
    sqlapi.register_lines(lines, "found_in")
    assert {(r.name, r.value) for r in spark.sql("SELECT name, value FROM found_in(1)").collect()} == {("surname", "SOME ONE"), ("date_of_birth", "01/02/1990")}
    want = {(r.doc_id, r.name, r.value) for r in extract.recognise(lines).collect()}
    lines.select("doc_id").distinct().createOrReplaceTempView("asked_docs")
    got = {(r.doc_id, r.name, r.value) for r in spark.sql("SELECT d.doc_id, f.name, f.value FROM asked_docs d, LATERAL found_in(d.doc_id) f").collect()}
    assert got == want
