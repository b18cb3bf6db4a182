"""Rules turn field maps into evidence flags, one row each: doc_id, code, severity, field, and seq, the rule's place in its family.

Flags are never verdicts. ``in_order`` numbers the flags of several families as the ledger takes them.

Fields come in long form: (doc_id, document_type, name, value, source, confidence); a blank value counts as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import checkdigits, dates, text
from evidentia.functions.barrier import once

HIGH, WARNING, INFO = "high", "warning", "info"

# What each document type must show, its secure machine-readable part, and its points.
REQUIRED = {
    "passport": ["document_number", "surname", "given_names", "date_of_birth", "date_of_expiry", "nationality"],
    "id_card": ["document_number", "surname", "given_names", "date_of_birth", "date_of_expiry"],
    "national_id": ["document_number", "surname", "date_of_birth"],
    "driving_license": ["document_number", "surname", "date_of_birth", "date_of_expiry"],
    "voter_id": ["document_number", "surname", "date_of_birth"],
    "pan_card": ["document_number", "surname", "date_of_birth"],
    "aadhaar": ["document_number", "surname", "date_of_birth"],
    "residence_permit": ["document_number", "surname", "date_of_birth", "date_of_expiry"],
}
ANCHORS = {"passport": "mrz", "id_card": "mrz", "residence_permit": "mrz", "aadhaar": "aadhaar_qr", "driving_license": "dl_barcode"}
# The letters that stand for a holder's status.
PAN_STATUS = "CPHFATBLJG"


def flags(rows: DataFrame, rules: list[tuple[Column, str | Column, str | Column, str | Column]], key: str = "doc_id") -> DataFrame:
    """(key, code, severity, field, seq) of each rule (condition, code, severity, field) that holds, from one pass over the rows."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    every = F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(k).alias("seq"), as_column(c).alias("code"), as_column(s).alias("severity"), as_column(f).alias("field"))) for k, (hit, c, s, f) in enumerate(rules)))
    found = F.filter(every, lambda x: x.isNotNull())
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.code", "f.severity", "f.field", "f.seq")


def required_fields(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """docs: doc_id, document_type, side. A back side of an aadhaar card requires nothing."""
    spark = docs.sparkSession
    needed = spark.createDataFrame([(t, n, k) for t, names in REQUIRED.items() for k, n in enumerate(names)], "document_type string, name string, seq int")
    asked = docs.where(~((F.col("document_type") == "aadhaar") & (F.col("side") == "back"))).join(F.broadcast(needed), "document_type")
    present = fields.where(F.trim("value") != "").select("doc_id", "name")
    missing = asked.join(present, ["doc_id", "name"], "left_anti")
    return missing.select("doc_id", F.lit("missing_required_field").alias("code"), F.lit(WARNING).alias("severity"), F.col("name").alias("field"), "seq")


def number_format(rows: DataFrame) -> DataFrame:
    """rows: doc_id, document_type, number."""
    fits = text.number_fits(F.col("document_type"), F.col("number"))
    return flags(rows, [((F.trim("number") != "") & ~fits, "document_number_format", WARNING, "document_number")])


def pan_structure(rows: DataFrame) -> DataFrame:
    """rows: doc_id, number, surname."""
    rows = once(rows.select("*", F.upper(text.cleaned_number(F.col("number"))).alias("__number")))
    number = F.col("__number")
    there = F.trim("number") != ""
    shape = number.rlike("^[A-Z]{3}.[A-Z][0-9]{4}[A-Z]$")
    words = F.array_remove(F.split(F.regexp_replace(F.upper("surname"), "[^A-Z]+", " "), " "), "")
    initials = F.array(F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.get(words, F.size(words) - 1), 1, 1))
    named = shape & (F.size(words) > 0)
    matches = F.array_contains(initials, F.substring(number, 5, 1))
    sound = checkdigits.mod36_check_char(number) == F.substring(number, 10, 1)
    f = "document_number"
    return flags(rows, [
        (there & ~shape, "pan_structure_invalid", WARNING, f),
        (there & shape & ~F.substring(number, 4, 1).isin(*PAN_STATUS), "pan_status_code_invalid", WARNING, f),
        (there & named & ~matches, "pan_name_char_mismatch", WARNING, f),
        (there & named & matches, "pan_name_char_match", INFO, f),
        (there & shape & sound, "pan_checksum_ok", INFO, f),
        (there & shape & ~sound, "pan_checksum_failed", WARNING, f),
    ])


def mrz_compliance(rows: DataFrame, checks: list[str]) -> DataFrame:
    """rows: doc_id, recognised, <check>_ok for each of ``checks`` (sorted by name) and composite_ok."""
    ok = F.col("recognised")
    fields = [(ok & ~F.col(f"{c}_ok"), "mrz_field_check_failed", WARNING, c) for c in sorted(checks)]
    all_ok = reduce(lambda a, b: a & b, [F.col(f"{c}_ok") for c in [*checks, "composite"]])
    return flags(rows, [(~ok, "mrz_unrecognized", WARNING, "mrz"), (ok & ~F.col("composite_ok"), "mrz_composite_check_failed", HIGH, "mrz"), *fields, (ok & all_ok, "mrz_checks_verified", INFO, "mrz")])


def date_logic(rows: DataFrame, reference: str) -> DataFrame:
    """rows: doc_id, birth, issue, expiry as texts."""
    now = F.lit(reference).cast("date")
    rows = once(rows.select("*", *(dates.parse(F.col(c), dates.LOGICAL).alias(n) for c, n in (("birth", "__b"), ("issue", "__i"), ("expiry", "__e")))))
    b, i, e = F.col("__b"), F.col("__i"), F.col("__e")
    given = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    age = dates.age(b, now)
    return flags(rows, [
        (given("birth") & b.isNull(), "invalid_date_format", WARNING, "date_of_birth"),
        (given("expiry") & e.isNull(), "invalid_date_format", WARNING, "date_of_expiry"),
        (given("issue") & i.isNull(), "invalid_date_format", WARNING, "date_of_issue"),
        (e < now, "expired", WARNING, "date_of_expiry"),
        (e < i, "expiry_before_issue", HIGH, "date_of_expiry"),
        (i < b, "issue_before_birth", HIGH, "date_of_issue"),
        (b > now, "dob_in_future", HIGH, "date_of_birth"),
        (i > now, "issue_in_future", HIGH, "date_of_issue"),
        ((b <= now) & (age > 120), "age_out_of_plausibility", WARNING, "date_of_birth"),
        (~given("birth"), "dob_missing", INFO, "date_of_birth"),
        (~given("expiry"), "expiry_missing", INFO, "date_of_expiry"),
        (~given("issue"), "issue_missing", INFO, "date_of_issue"),
    ])


def cross_source(rows: DataFrame) -> DataFrame:
    """rows: doc_id, mrz_birth, mrz_expiry (ISO), mrz_number, birth, expiry, number, number_source."""
    differs = lambda a, b: (dates.parse(F.col(a)) != dates.parse(F.col(b)))
    number = text.cleaned_number(F.col("mrz_number"))
    printed = F.upper(text.cleaned_number(F.col("number")))
    return flags(rows, [
        (differs("mrz_birth", "birth"), "cross_source_date_mismatch", WARNING, "date_of_birth"),
        (differs("mrz_expiry", "expiry"), "cross_source_date_mismatch", WARNING, "date_of_expiry"),
        ((F.col("number_source") == "visual") & (F.trim("number") != "") & (number != "") & (number != printed), "cross_source_number_mismatch", WARNING, "document_number"),
    ])


def qr_consistency(rows: DataFrame) -> DataFrame:
    """rows: doc_id, signed, qr_uid, qr_birth, qr_name, qr_gender, number, birth, surname, sex (printed)."""
    rows = once(rows.select("*", checkdigits.verhoeff_valid(F.trim("qr_uid")).alias("__valid"), text.name_words(F.col("surname")).alias("__mine"), text.name_words(F.col("qr_name")).alias("__theirs")))
    uid, valid, mine, theirs = F.trim("qr_uid"), F.col("__valid"), F.col("__mine"), F.col("__theirs")
    has = F.coalesce(uid, F.lit("")) != ""
    named = (F.size(mine) > 0) & (F.size(theirs) > 0)
    g, h = text.gender(F.col("sex")), text.gender(F.col("qr_gender"))
    return flags(rows, [
        (F.col("signed"), "aadhaar_qr_signed_payload", INFO, "machine_readable_zone"),
        (has & valid, "aadhaar_qr_checksum_ok", INFO, "document_number"),
        (has & ~valid, "aadhaar_qr_checksum_failed", HIGH, "document_number"),
        (has & (text.digits(uid) != text.digits(F.col("number"))), "aadhaar_qr_number_mismatch", HIGH, "document_number"),
        (dates.parse(F.col("qr_birth")) != dates.parse(F.col("birth")), "aadhaar_qr_dob_mismatch", WARNING, "date_of_birth"),
        (named & (mine == theirs), "aadhaar_qr_name_match", INFO, "surname"),
        (named & (mine != theirs), "aadhaar_qr_name_mismatch", WARNING, "surname"),
        (g == h, "aadhaar_qr_gender_match", INFO, "sex"),
        (g != h, "aadhaar_qr_gender_mismatch", WARNING, "sex"),
    ])


def licence_barcode(rows: DataFrame) -> DataFrame:
    """rows: doc_id, code_number, code_birth, number, birth."""
    a, b = (F.upper(F.regexp_replace(F.col(c), "[^A-Za-z0-9]", "")) for c in ("code_number", "number"))
    return flags(rows, [
        ((a != "") & (b != "") & (a != b), "dl_barcode_number_mismatch", HIGH, "document_number"),
        (dates.parse(F.col("code_birth")) != dates.parse(F.col("birth")), "dl_barcode_dob_mismatch", WARNING, "date_of_birth"),
    ])


def number_checksum(rows: DataFrame) -> DataFrame:
    """rows: doc_id, number of a 12-digit type; other lengths say nothing."""
    d = text.digits(F.col("number"))
    valid = checkdigits.verhoeff_valid(d)
    return flags(rows, [((F.length(d) == 12) & ~valid, "aadhaar_checksum_failed", HIGH, "document_number"), ((F.length(d) == 12) & valid, "aadhaar_checksum_ok", INFO, "document_number")])


def secure_anchor(docs: DataFrame, channels: DataFrame) -> DataFrame:
    """docs: doc_id, document_type, side; channels: doc_id, channel, of what could be decoded."""
    wanted = docs.sparkSession.createDataFrame(list(ANCHORS.items()), "document_type string, channel string")
    lacking = docs.join(F.broadcast(wanted), "document_type").join(channels, ["doc_id", "channel"], "left_anti")
    front = (F.col("document_type") == "aadhaar") & (F.col("side") == "front")
    code, severity = F.when(front, "anchor_not_verifiable").otherwise("secure_anchor_missing"), F.when(front, INFO).otherwise(WARNING)
    return lacking.select("doc_id", code.alias("code"), severity.alias("severity"), F.lit("machine_readable_zone").alias("field"), F.lit(0).alias("seq"))


IDENTIFIERS = ["number", "surname", "given_names"]


def _identifier_keys(rows: DataFrame) -> DataFrame:
    """``rows`` once for each choice of the identifiers they have: mask (those they have), chosen, and the values as a key."""
    held = [c for c in IDENTIFIERS if c in rows.columns]
    value = {c: F.nullif(F.upper(F.trim(F.col(c))), F.lit("")) for c in held}
    mask = sum((F.when(value[c].isNotNull(), 1 << IDENTIFIERS.index(c)).otherwise(0) for c in held), F.lit(0))
    choices = []
    for chosen in range(1, 1 << len(IDENTIFIERS)):
        mine = [c for k, c in enumerate(IDENTIFIERS) if chosen >> k & 1]
        if set(mine) <= set(held):
            choices.append(F.when(mask.bitwiseAND(F.lit(chosen)) == chosen, F.struct(F.lit(chosen).alias("chosen"), F.array(*(value[c] for c in mine)).alias("key"))))
    return rows.withColumn("mask", mask).withColumn("k", F.explode_outer(F.filter(F.array(*choices), lambda x: x.isNotNull()))).select("*", "k.chosen", "k.key")


def blacklist(rows: DataFrame, listing: DataFrame | None) -> DataFrame:
    """rows: doc_id and of number, surname, given_names what there is; listing: the same and listed (true, false, or null where the source failed); None: no source.

    A row and a listed record meet in the identifiers that both have, one at least, and agree in all of these. A number that is
    listed under other names is evidence of its own, never clear: the names may be misread, or the number borrowed.
    """
    if listing is None:
        return rows.select("doc_id", F.lit("blacklist_not_configured").alias("code"), F.lit(INFO).alias("severity"))
    known = _identifier_keys(listing).where(F.col("chosen").isNotNull()).groupBy("mask", "chosen", "key").agg(F.max("listed").alias("listed"), F.max(F.col("listed").isNull()).alias("failed"))
    known = known.select(F.col("mask").alias("theirs"), "chosen", "key", "listed", "failed")
    asked = _identifier_keys(rows).select("doc_id", "mask", "chosen", "key")
    met = F.col("mask").bitwiseAND(F.col("theirs")) == F.col("chosen")
    hits = asked.join(known, ["chosen", "key"], "left").groupBy("doc_id").agg(F.max("mask").alias("mask"), F.max(F.when(met, F.col("listed"))).alias("listed"), F.max(F.when(met, F.col("failed"))).alias("failed"), F.max(F.when(F.col("chosen") == 1 << IDENTIFIERS.index("number"), F.col("listed"))).alias("number_listed"))
    code = F.when(F.col("mask") == 0, "blacklist_no_identifiers").when(F.col("listed"), "blacklist_hit").when(F.col("number_listed"), "blacklist_number_listed").when(F.col("failed"), "blacklist_lookup_failed").otherwise("blacklist_clear")
    severity = F.when(code.isin("blacklist_hit", "blacklist_number_listed", "blacklist_lookup_failed"), WARNING).otherwise(INFO)
    return hits.select("doc_id", code.alias("code"), severity.alias("severity"))


def blacklist_by(rows: DataFrame, lookup) -> DataFrame:
    """The blacklist flag of each row by ``lookup``, a function of a mapping of the row's identifiers to true, false or None.

    None and an exception are a failed look-up of that row, not of its task. The function runs on the executors, a partition at
    a time; rows without identifiers aren't looked up. rows: doc_id and of number, surname, given_names what there is.
    """
    held = [c for c in IDENTIFIERS if c in rows.columns]

    def run(frames):
        for frame in frames:
            codes = []
            for row in frame[held].itertuples(index=False):
                query = {n: v.strip() for n, v in zip(held, row, strict=True) if isinstance(v, str) and v.strip()}
                try:
                    said = lookup(query) if query else None
                except Exception:
                    said = None
                codes.append("blacklist_no_identifiers" if not query else "blacklist_lookup_failed" if said is None else "blacklist_hit" if said else "blacklist_clear")
            yield frame[["doc_id"]].assign(code=codes)

    found = rows.select("doc_id", *held).mapInPandas(run, T.StructType([rows.schema["doc_id"], T.StructField("code", T.StringType())]))
    return found.withColumn("severity", F.when(F.col("code").isin("blacklist_hit", "blacklist_lookup_failed"), WARNING).otherwise(INFO))


def in_order(families: list[DataFrame]) -> DataFrame:
    """doc_id, seq from 1, code, severity, field of all flags: family by family, and a family's by its rules' order."""
    every = None
    for k, rows in enumerate(families):
        rule = F.col("seq") if "seq" in rows.columns else F.lit(0)
        field = F.col("field") if "field" in rows.columns else F.lit(None).cast("string")
        part = rows.select("doc_id", "code", "severity", field.alias("field"), F.lit(k).alias("family"), rule.alias("rule"))
        every = part if every is None else every.unionByName(part)
    order = Window.partitionBy("doc_id").orderBy("family", "rule", "code", "field")
    return every.select("doc_id", F.row_number().over(order).alias("seq"), "code", "severity", "field")


# Number patterns of the field validator by type name.
FIELD_PATTERNS = {"Passport": "^[A-Z]-?[0-9]{6,9}$", "Visa": "^V-?[0-9]{4,9}$", "National ID": "^ID-?[0-9]{4,9}$", "Driving Licence": "^DL-?[0-9]{4,9}$", "Permit": "^PM-?[0-9]{4,9}$", "Aadhaar": r"^[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}$", "PAN": "^[A-Z]{5}[0-9]{4}[A-Z]$"}


def field_validation(rows: DataFrame, reference: str, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, is_valid, errors, warnings (codes, joined); rows: doc_id, document_type, name, document_number, nationality, date_of_birth, issue_date, expiry_date.

    ``findings``: flags of the reading (doc_id, seq, code, severity, field); high ones follow the errors, warnings the warnings.
    """
    now = F.lit(reference).cast("date")
    kind, number = F.lower("document_type"), F.regexp_replace("document_number", "[ -]", "")
    few = kind.isin("aadhaar", "pan", "pan_card")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = once(rows.select("*", *(dates.parse(F.col(c), dates.FIELDS).alias(n) for c, n in (("date_of_birth", "__b"), ("issue_date", "__i"), ("expiry_date", "__e")))))
    b, i, e = F.col("__b"), F.col("__i"), F.col("__e")
    is_uid = kind.isin("aadhaar", "uidai") | number.rlike("^[0-9]{12}$")
    is_pan = kind.isin("pan", "pan_card") | F.upper(number).rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")
    has = F.coalesce(number, F.lit("")) != ""
    pan_ok = F.upper(number).rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")
    usual = F.lit(True)
    for name, pattern in FIELD_PATTERNS.items():
        usual = F.when(F.col("document_type") == name, F.upper("document_number").rlike(pattern)).otherwise(usual)
    errors = [(blank(c) & (~few if k > 1 else F.lit(True)), f"missing:{c}") for k, c in enumerate(("name", "document_number", "nationality", "date_of_birth", "issue_date", "expiry_date"))]
    errors += [(~blank(c) & d.isNull(), f"format:{c}") for c, d in (("date_of_birth", b), ("issue_date", i), ("expiry_date", e))]
    errors += [(b > now, "future:date_of_birth"), (i >= e, "order:issue_expiry"), (F.year(i) < F.year(b), "order:birth_issue")]
    errors += [(is_uid & has & ~number.rlike("^[0-9]{12}$"), "aadhaar:digits"), (is_uid & number.rlike("^[0-9]{12}$") & ~checkdigits.verhoeff_valid(number), "aadhaar:checksum"), (is_pan & has & ~pan_ok, "pan:format")]
    warnings = [(e < now, "expired"), (is_pan & pan_ok & ~F.substring(F.upper(number), 4, 1).isin(*PAN_STATUS), "pan:entity"), (~blank("document_number") & ~usual, "number:unusual")]
    listed = lambda rules: F.concat_ws(",", *(F.when(c, code) for c, code in rules))
    out = rows.select("doc_id", listed(errors).alias("errors"), listed(warnings).alias("warnings"))
    if findings is not None:
        told = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("seq", "code", "field")))), lambda x: F.concat(F.lit("ocr:"), x["code"]))
        more = findings.groupBy("doc_id").agg(told(HIGH).alias("__high"), told(WARNING).alias("__low"))  # a document's flags are few
        joined = lambda own, given: F.array_join(F.filter(F.concat(F.array(own), F.coalesce(given, F.array().cast("array<string>"))), lambda x: x != ""), ",")
        out = out.join(more, "doc_id", "left").select("doc_id", joined("errors", F.col("__high")).alias("errors"), joined("warnings", F.col("__low")).alias("warnings"))
    return out.select("doc_id", (F.col("errors") == "").alias("is_valid"), "errors", "warnings")


def expiry_days(rows: DataFrame, reference: str) -> DataFrame:
    """doc_id, expired, days_to_expiry (negative once expired) from expiry texts; both null without a date."""
    expiry, now = dates.parse(F.col("expiry"), dates.LOGICAL), F.lit(reference).cast("date")
    return rows.select("doc_id", (expiry < now).alias("expired"), F.date_diff(expiry, now).alias("days_to_expiry"))
