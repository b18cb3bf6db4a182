"""Scores that can be traced: the deduction ledger, the coherence score, risk factors and reasons, forensic status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

# Points taken by severity, caps of the two pools, and the other deductions.
POINTS = {"high": 22.0, "warning": 8.0, "info": 0.0}
FLAG_CAP, CONFIDENCE_CAP, PER_FIELD, LOW_CONFIDENCE, UNKNOWN_TYPE = 60.0, 10.0, 2.0, 0.6, 25.0

# Weights of the eight risk factors, and how much of its weight each status takes.
WEIGHTS = {"validation": 10.0, "tampering": 20.0, "face": 10.0, "identity": 20.0, "status": 15.0, "dna": 10.0, "checkpoint": 5.0, "network": 10.0}
STATUS_SHARE = {"BLACKLISTED": 1.0, "REVOKED": 0.9, "EXPIRED": 0.4, "VALID": 0.0}


def _points(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, points in POINTS.items():
        out = F.when(severity == name, points).otherwise(out)
    return out


def ledger(flags: DataFrame) -> DataFrame:
    """Each flag (doc_id, seq, code, severity) with its deduction within the cap and the balance after it."""
    nominal = _points(F.col("severity"))
    upto = F.sum(nominal).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    taken = F.least(F.lit(FLAG_CAP), upto) - F.least(F.lit(FLAG_CAP), upto - nominal)
    return flags.select("doc_id", "seq", "code", "severity", taken.alias("deduction"), (100 - F.least(F.lit(FLAG_CAP), upto)).alias("balance"))


def full_ledger(docs: DataFrame, flags: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, seq, code, severity, field, deduction, balance: flags in order, then unsure fields by name, the unknown type, and what remains.

    docs: doc_id, document_type; flags: doc_id, seq, code, severity, field; fields: doc_id, name, confidence.
    """
    row = lambda part, seq, code, severity, field, nominal, cap: (F.lit(part).alias("part"), seq.cast("int").alias("n"), code.alias("code"), severity.alias("severity"), field.cast("string").alias("field"), nominal.alias("nominal"), F.lit(cap).alias("cap"))
    said = lambda x: F.lit(x)
    unsure = fields.where(F.col("confidence") < LOW_CONFIDENCE).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("name")))
    every = flags.select("doc_id", *row(0, F.col("seq"), F.col("code"), F.col("severity"), F.col("field"), _points(F.col("severity")), FLAG_CAP))
    every = every.unionByName(unsure.select("doc_id", *row(1, F.col("n"), said("low_ocr_confidence"), said("info"), F.col("name"), said(PER_FIELD), CONFIDENCE_CAP)))
    every = every.unionByName(docs.where("document_type = 'unknown'").select("doc_id", *row(2, said(0), said("unknown_type_penalty"), said("info"), said(None), said(UNKNOWN_TYPE), UNKNOWN_TYPE)))
    every = every.unionByName(docs.select("doc_id", *row(3, said(0), said("remaining_points"), said("info"), said(None), said(0.0), 0.0)))
    upto = F.sum("nominal").over(Window.partitionBy("doc_id", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    order = Window.partitionBy("doc_id").orderBy("part", "n")
    rows = every.withColumn("deduction", F.least("cap", upto) - F.least("cap", upto - F.col("nominal")))
    left = 100 - F.sum("deduction").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"balance": F.when(F.col("part") == 3, F.greatest(left, F.lit(0.0))).otherwise(left), "seq": F.row_number().over(order)})
    return rows.select("doc_id", "seq", "code", "severity", "field", "deduction", "balance")


def coherence(docs: DataFrame, flags: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, counts by severity, the three deductions and the score; docs: doc_id, document_type; fields: doc_id, confidence."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    by_flag = flags.groupBy("doc_id").agg(count("high"), count("warning"), count("info"), F.sum(_points(F.col("severity"))).alias("points"))
    unsure = fields.where(F.col("confidence") < LOW_CONFIDENCE).groupBy("doc_id").agg(F.count(F.lit(1)).alias("unsure"))
    rows = docs.join(by_flag, "doc_id", "left").join(unsure, "doc_id", "left").na.fill(0, ["n_high", "n_warning", "n_info", "points", "unsure"])
    rows = rows.withColumn("flag_deductions", F.least(F.lit(FLAG_CAP), F.col("points")))
    rows = rows.withColumn("confidence_deductions", F.least(F.lit(CONFIDENCE_CAP), F.col("unsure") * PER_FIELD))
    rows = rows.withColumn("unknown_penalty", F.when(F.col("document_type") == "unknown", UNKNOWN_TYPE).otherwise(0.0))
    score = F.greatest(F.lit(0.0), 100 - F.col("flag_deductions") - F.col("confidence_deductions") - F.col("unknown_penalty"))
    return rows.select("doc_id", "n_high", "n_warning", "n_info", "flag_deductions", "confidence_deductions", "unknown_penalty", F.bround(score).cast("int").alias("score"))


def risk_factors(rows: DataFrame) -> DataFrame:
    """The rows with a column f_<factor> each; a factor whose input is null is null.

    rows: is_valid, n_warnings, tamper_confidence, face_match, face_similarity, identity_matches, status,
    dna_related, dna_score, checkpoint_alert, connected_cases.
    """
    w = WEIGHTS
    share = F.lit(0.3)
    for name, part in STATUS_SHARE.items():
        share = F.when(F.col("status") == name, part).otherwise(share)
    factors = {
        "validation": F.least(F.lit(w["validation"]), F.when(F.col("is_valid"), 0.0).otherwise(10.0) + F.least(2.0 * F.col("n_warnings"), F.lit(5.0))),
        "tampering": F.col("tamper_confidence") * w["tampering"],
        "face": F.when(F.col("face_match"), 0.0).otherwise(w["face"] * (1 - F.col("face_similarity"))),
        "identity": F.when(F.col("identity_matches") > 0, w["identity"]).otherwise(0.0),
        "status": share * w["status"],
        "dna": F.when(F.col("dna_related") > 0, F.col("dna_score") / 100 * w["dna"]).otherwise(0.0),
        "checkpoint": F.when(F.col("checkpoint_alert"), w["checkpoint"]).otherwise(0.0),
        "network": F.when(F.col("connected_cases") > 1, F.least(1.5 * F.col("connected_cases"), F.lit(w["network"]))).otherwise(0.0),
    }
    needs = {"validation": "is_valid", "tampering": "tamper_confidence", "face": "face_similarity", "identity": "identity_matches", "status": "status", "dna": "dna_related", "checkpoint": "checkpoint_alert", "network": "connected_cases"}
    return rows.withColumns({f"f_{n}": F.when(F.col(needs[n]).isNotNull(), F.round(c, 6)) for n, c in factors.items()})


def risk_total() -> Column:
    """The sum of the factors there are, at most 100, to a whole number, halves to even."""
    total = F.lit(0.0)
    for name in WEIGHTS:
        total = total + F.coalesce(F.col(f"f_{name}"), F.lit(0.0))
    return F.bround(F.least(F.lit(100.0), F.round(total, 6))).cast("int")


def band(score: Column) -> Column:
    return F.when(score <= 39, "LOW").when(score <= 74, "MEDIUM").otherwise("HIGH")


def reasons() -> Column:
    """The reasons of a row of risk inputs in fixed order, or one sentence for none.

    Besides the inputs of ``risk_factors``: tamper_status, tamper_findings, face_status and face_count (of the detector, null where
    there was none), matches (identity_id, similarity; best first), status_detail (of a blacklisted document),
    common_pattern and validation_errors (codes).
    """
    one = lambda hit, text: F.when(F.coalesce(hit, F.lit(False)), F.array(text if isinstance(text, Column) else F.lit(text)))
    number = lambda c: F.col(c).cast("string")
    pattern = F.when(F.col("common_pattern").isNotNull(), F.concat(F.lit(" (pattern "), F.col("common_pattern"), F.lit(")"))).otherwise("")
    said = [
        F.when(F.col("tamper_status") != "CLEAN", F.col("tamper_findings")),
        one(~F.col("face_match"), "Face similarity is below the threshold."),
        one(F.col("face_status") == "NO_FACE_DETECTED", "No face detected in the document image."),
        one(F.col("face_status") == "MULTIPLE_FACES", F.concat(F.lit("Faces detected in the document image: "), number("face_count"), F.lit("."))),
        one(F.col("face_status").isin("LOW_QUALITY", "INVALID_IMAGE"), F.concat(F.lit("Face image of insufficient quality: "), "face_status", F.lit("."))),
        one(F.col("face_status") == "ALIGNMENT_FAILED", "The detected face could not be aligned."),
        F.transform("matches", lambda m: F.concat(F.lit("Similar identity "), m["identity_id"].cast("string"), F.lit(" ("), text.percent(m["similarity"]), F.lit("): for review."))),
        one(F.col("status") == "BLACKLISTED", F.concat(F.lit("Document is blacklisted"), F.coalesce(F.concat(F.lit(" ("), "status_detail", F.lit(")")), F.lit("")), F.lit("."))),
        one(F.col("status") == "EXPIRED", "Document has expired."),
        one(F.col("status") == "REVOKED", "Document has been revoked."),
        one(F.col("dna_related") > 0, F.concat(F.lit("Structural pattern shared with documents: "), number("dna_related"), F.lit("."))),
        one(F.col("connected_cases") > 1, F.concat(F.lit("Connected documents: "), number("connected_cases"), pattern, F.lit("."))),
        one(F.col("checkpoint_alert"), "Pattern seen at several checkpoints."),
        F.transform("validation_errors", lambda e: F.concat(F.lit("Validation error: "), e, F.lit("."))),
    ]
    found = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in said))
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise("No significant risk indicators detected.")


def forensic_status(rows: DataFrame, with_bias: bool = False) -> DataFrame:
    """rows (signals ela, edge_density, blur, and bias if asked for) with confidence, status and findings."""
    score = F.when(F.col("ela") > 6, 0.35).otherwise(0.0) + F.when(F.col("edge_density") < 0.02, 0.2).otherwise(0.0) + F.when(F.col("blur") < 50, 0.15).otherwise(0.0)
    if with_bias:
        score = score + F.col("bias") * 0.3
    said = [F.when(F.col("ela") > 6, "Compression differs across the image."), F.when(F.col("edge_density") < 0.02, "Few edges: smoothed or spliced."), F.when(F.col("blur") < 50, "Little local sharpness: a region may be pasted in.")]
    rows = rows.withColumn("findings", F.filter(F.array(*said), lambda x: x.isNotNull()))
    rows = rows.withColumn("confidence", F.least(F.bround(score, 2), F.lit(0.99)))
    return rows.withColumn("status", F.when(F.col("confidence") >= 0.7, "TAMPERED").when(F.col("confidence") >= 0.35, "SUSPICIOUS").otherwise("CLEAN"))
