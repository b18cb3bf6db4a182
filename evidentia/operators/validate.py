"""One plan from text lines to fields, flags, ledger and score: ``validate_lines`` for any number of documents at once.

Lines are (doc_id, line_no, text) with confidence, x and the box (x0, y0, x1, y1) where there are any. Documents are (doc_id) with side, forced_type,
unreadable, companion_unreadable, ocr_failed, template_failed (its boxes aren't read then) and barcode_failed where there are any. Barcodes are the parts
that ``intake.barcode_parts`` gives: (doc_id, seq, channel, name, value). Flags are evidence for people to review, never
verdicts.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import mrz
from evidentia.functions.barrier import once, settled
from evidentia.operators import extract, intake, layout, rules, scoring

MRZ_CONFIDENCE = 1.0
_ZONE = ["recognised", "document_type", "document_number", "nationality", "birth", "sex", "expiry", "optional", "surname", "given_names", "composite_ok", "document_number_ok", "birth_ok", "expiry_ok", "optional_ok"]
_STATES = {"side": "string", "forced_type": "string", "unreadable": "boolean", "companion_unreadable": "boolean", "ocr_failed": "boolean", "template_failed": "boolean", "barcode_failed": "boolean"}


class Validated(NamedTuple):
    """results: one row a document; fields, flags and ledger: doc_id and one row each, ledger and flags numbered by seq."""

    results: DataFrame
    fields: DataFrame
    flags: DataFrame
    ledger: DataFrame


def zones(lines: DataFrame) -> DataFrame:
    """doc_id, fmt and the parsed columns of each document's machine-readable zone, whatever its format."""
    block = once(extract.mrz_block(lines))
    by = {fmt: mrz.parse(fmt, [F.col(c) for c in ("l1", "l2", "l3")]) for fmt in mrz.SHAPES}

    def column(name):
        given = [(fmt, cols.get(name, F.lit(True))) for fmt, cols in by.items() if name in cols or name.endswith("_ok")]
        return F.coalesce(*(F.when(F.col("fmt") == fmt, c) for fmt, c in given)).alias(name)

    return once(block.select("doc_id", "fmt", *(column(n) for n in _ZONE)))


def zone_fields(zone: DataFrame, reference_year: int) -> DataFrame:
    """doc_id, name, value, confidence of a zone's fields: dates as ISO dates where the calendar has them."""
    plain = lambda c: F.trim(F.replace(F.col(c), F.lit("<"), F.lit(" ")))
    iso = lambda c, past: F.coalesce(mrz.iso_date(F.col(c), reference_year, past), plain(c))
    values = {
        "document_number": plain("document_number"), "nationality": plain("nationality"), "sex": plain("sex"), "personal_number": F.when(F.col("fmt") == "TD3", plain("optional")),
        "date_of_birth": iso("birth", True), "date_of_expiry": iso("expiry", False), "surname": F.col("surname"), "given_names": F.col("given_names"),
    }
    each = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items())), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return zone.where("recognised").select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.*", F.lit(MRZ_CONFIDENCE).alias("confidence"))


def merged_fields(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """doc_id, name, value, confidence, source: of each field the first source that has it; rows may name a closer source."""
    named = lambda rows, source: F.col("source") if "source" in rows.columns else F.lit(source).alias("source")
    every = [rows.select("doc_id", "name", F.struct(F.lit(k).alias("rank"), "value", named(rows, source), F.col("confidence").cast("double").alias("confidence")).alias("b")) for k, (source, rows) in enumerate(sources)]
    best = reduce(DataFrame.unionByName, every).groupBy("doc_id", "name").agg(F.min("b").alias("b"))
    return best.select("doc_id", "name", "b.value", "b.confidence", "b.source")


def _wide(rows: DataFrame, names: dict[str, str], value: str = "value") -> DataFrame:
    return rows.groupBy("doc_id").agg(*(F.max(F.when(F.col("name") == n, F.col(value))).alias(out) for n, out in names.items()))


def validate_lines(lines: DataFrame, reference: str, docs: DataFrame | None = None, barcodes: DataFrame | None = None, listing: DataFrame | None = None) -> Validated:
    """Fields from the print, the barcodes and the zone, in this order of preference; flags in the order of the rules; ledger and score.

    ``listing``: the blacklist's records, as ``rules.blacklist`` takes them. A document without lines is one without text.
    An unreadable one is of unknown type with no points. What many rules read (lines, barcodes, zones, fields, states, flags)
    is computed once, into the checkpoint folder.
    """
    spark, year = lines.sparkSession, int(reference[:4])
    lines, barcodes = settled(lines), None if barcodes is None else settled(barcodes)
    docs = lines.select("doc_id").distinct() if docs is None else docs
    docs = docs.select("doc_id", *(F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in _STATES.items()))
    kind = lines.schema["doc_id"].dataType.simpleString()
    barcodes = spark.createDataFrame([], f"doc_id {kind}, seq int, channel string, name string, value string") if barcodes is None else barcodes
    whole = docs.where(~F.coalesce("unreadable", F.lit(False)))
    zone = settled(zones(lines))
    # what each document is, where its fields may stand, and what they are
    auto = extract.classify(lines, zone.where("recognised").select("doc_id", F.col("document_type").alias("mrz_type")))
    auto = settled(whole.join(auto.withColumnsRenamed({"document_type": "auto_type", "confidence": "auto_confidence"}), "doc_id", "left").na.fill(0, ["auto_confidence"]).na.fill("unknown", ["auto_type"]))
    visual = extract.recognise(lines).withColumn("source", F.lit("visual"))
    reads = None
    if set(layout.BOX) <= set(lines.columns):
        kinds = auto.where(~F.coalesce("template_failed", F.lit(False))).select("doc_id", F.coalesce("forced_type", "auto_type").alias("document_type"))
        sure = lines if "confidence" in lines.columns else lines.withColumn("confidence", F.lit(1.0))
        reads = settled(layout.template_reads(sure, kinds, layout.templates(spark)).drop("document_type"))
        visual = extract.merge_template(visual.drop("source"), reads)
    fields = merged_fields([("visual", visual), ("barcode", intake.barcode_fields(barcodes)), ("mrz", zone_fields(zone, year))]).join(whole.select("doc_id"), "doc_id", "left_semi")
    fields = settled(fields)

    # how it could be read
    zone_like = (F.length(F.regexp_replace("text", r"\s", "")) >= 28) & F.regexp_replace("text", r"\s", "").rlike("^[A-Z0-9<]*<[A-Z0-9<]*$")
    read = lines.groupBy("doc_id").agg(F.max(F.trim("text") != "").alias("has_text"), F.max(zone_like).alias("zone_like"))
    decoded = barcodes.groupBy("doc_id").agg(F.count_distinct("seq").alias("n_barcodes"), F.max(F.col("channel") == "aadhaar_qr").alias("has_qr"))
    counted = reads.groupBy("doc_id").agg(F.count(F.lit(1)).alias("template_reads")) if reads is not None else docs.limit(0).select("doc_id", F.lit(0).alias("template_reads"))
    state = auto.join(read, "doc_id", "left").join(decoded, "doc_id", "left").join(counted, "doc_id", "left")
    state = state.join(zone.select("doc_id", F.col("recognised").alias("has_zone")), "doc_id", "left").na.fill(False, ["companion_unreadable", "ocr_failed", "template_failed", "barcode_failed", "has_text", "zone_like", "has_qr", "has_zone"]).na.fill(0, ["template_reads", "n_barcodes"])
    state = settled(state.withColumn("document_type", F.coalesce("forced_type", "auto_type")))
    typed = state.select("doc_id", "document_type", F.coalesce("side", F.lit("")).alias("side"))
    of = lambda t, rows: rows.join(typed.where(F.col("document_type") == t).select("doc_id"), "doc_id", "left_semi")

    print_ = _wide(fields, {"document_number": "number", "surname": "surname", "given_names": "given_names", "date_of_birth": "birth", "issue_date": "issue", "date_of_expiry": "expiry", "sex": "sex"})
    print_ = settled(print_)
    values = typed.join(print_, "doc_id", "left")
    payload = lambda channel, names: _wide(barcodes.where(F.col("channel") == channel), names)
    qr = payload("aadhaar_qr", {"uid": "qr_uid", "dob": "qr_birth", "name": "qr_name", "gender": "qr_gender", "signature_present": "signed"}).withColumn("signed", F.coalesce(F.col("signed") == "true", F.lit(False)))
    licence = payload("dl_barcode", {"document_number": "code_number", "date_of_birth": "code_birth"})
    channels = barcodes.select("doc_id", "channel").unionByName(zone.where("recognised").select("doc_id", F.lit("mrz").alias("channel"))).distinct()
    both = zone.where("recognised").select("doc_id", mrz.iso_date(F.col("birth"), year, True).alias("mrz_birth"), mrz.iso_date(F.col("expiry"), year, False).alias("mrz_expiry"), F.col("document_number").alias("mrz_number"))
    sources = _wide(fields, {"document_number": "number_source"}, "source")

    families = [
        rules.flags(state, [
            (F.col("companion_unreadable"), "companion_image_preprocessing_failed", rules.WARNING, None),
            (F.col("ocr_failed"), "ocr_extraction_failed", rules.WARNING, None),
            (~F.col("ocr_failed") & ~F.col("has_text"), "ocr_no_text", rules.WARNING, None),
            (~F.col("ocr_failed") & F.col("has_text"), "ocr_read_from", rules.INFO, None),
            (F.col("template_failed"), "template_roi_failed", rules.INFO, None),
            (F.col("template_reads") > 0, "template_roi_applied", rules.INFO, None),
            (F.col("barcode_failed"), "barcode_read_failed", rules.INFO, None),
            (F.col("n_barcodes") > 0, "machine_channel_read", rules.INFO, None),
            (F.col("zone_like") & ~F.col("has_zone"), "mrz_detection_failed", rules.WARNING, None),
            ((F.col("auto_type") != "unknown") & (F.col("forced_type") != F.col("auto_type")), "type_hint_conflict", rules.WARNING, None),
        ]),
        rules.date_logic(values, reference),
        rules.required_fields(typed, fields),
        rules.number_format(values),
        rules.number_checksum(of("aadhaar", values)),
        rules.qr_consistency(of("aadhaar", qr.join(print_, "doc_id", "left"))),
        rules.licence_barcode(of("driving_license", licence.join(print_, "doc_id", "left"))),
        rules.pan_structure(of("pan_card", values)),
        rules.secure_anchor(typed, channels),
        rules.mrz_compliance(zone, ["document_number", "birth", "expiry", "optional"]),
        rules.cross_source(both.join(print_, "doc_id", "left").join(sources, "doc_id", "left")),
        rules.blacklist(values.select("doc_id", "number", "surname", "given_names"), listing),
        rules.flags(state, [((F.col("document_type") == "aadhaar") & F.col("side").isin("back", "both") & ~F.col("has_qr"), "anchor_crop_hint", rules.INFO, None)]),
    ]
    flags = settled(rules.in_order([rows.join(whole.select("doc_id"), "doc_id", "left_semi") for rows in families]))
    lost = docs.where("unreadable").select("doc_id")
    broken = lost.select("doc_id", F.lit(1).alias("seq"), F.lit("image_preprocessing_failed").alias("code"), F.lit(rules.WARNING).alias("severity"), F.lit(None).cast("string").alias("field"))
    scored = scoring.coherence(typed, flags, fields)
    sure = state.select("doc_id", "document_type", F.when(F.col("forced_type").isNotNull(), 1.0).otherwise(F.col("auto_confidence")).alias("classification_confidence"), F.col("has_zone").alias("mrz_found"))
    results = sure.join(scored.select("doc_id", "n_high", "n_warning", "n_info", "score"), "doc_id")
    zero = lambda n, t: F.lit(0).cast(t).alias(n)
    nothing = lost.select("doc_id", F.lit("unknown").alias("document_type"), F.lit(0.0).alias("classification_confidence"), F.lit(False).alias("mrz_found"), zero("n_high", "long"), F.lit(1).cast("long").alias("n_warning"), zero("n_info", "long"), zero("score", "int"))
    ledger = scoring.full_ledger(typed.select("doc_id", "document_type"), flags, fields)
    return Validated(results.unionByName(nothing), fields, flags.unionByName(broken), ledger)
