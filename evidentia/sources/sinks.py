"""Append-only sinks and small sources: verification records, audit rows, cases, decisions, reports, known faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import boxes
from evidentia.operators import registry

PICTURES = r"(?i).*\.(jpg|jpeg|png)$"


def verification_records(results: DataFrame, id_col: str, at: str) -> DataFrame:
    """verification_id (the whole hash of record and time, so that a rerun of one time gives the same), result_json, created_at."""
    payload = F.to_json(F.struct(*sorted(results.columns)))
    return results.select(F.concat(F.lit("VER-"), F.upper(F.sha2(F.concat(payload, F.lit("@" + at)).cast("binary"), 256))).alias("verification_id"), F.col(id_col).cast("string").alias("subject"), payload.alias("result_json"), F.lit(at).cast("timestamp").alias("created_at"))


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Adds the rows to a Parquet table; nothing there is ever rewritten."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_audit(results: DataFrame, id_col: str, outcome_col: str, path: str) -> None:
    append(registry.audit_rows(results, id_col, outcome_col), path)


def append_case(spark: SparkSession, path: str, document_number: str, fraud_type: str, features: list[str], officer_id: str, notes: str | None, at: str) -> None:
    row = [(document_number, fraud_type, features, officer_id, notes, at)]
    rows = spark.createDataFrame(row, "document_number string, fraud_type string, detected_features array<string>, officer_id string, officer_notes string, confirmed_at string")
    append(rows.withColumn("confirmed_at", F.to_timestamp("confirmed_at")), path)


def append_decision(spark: SparkSession, path: str, records: DataFrame, verification_id: str, decision: str, at: str, decision_id: int) -> bool:
    """Appends an officer's decision; false, and nothing written, if there is no such record."""
    if decision not in ("CLEARED", "SECONDARY_INSPECTION", "DENIED"):
        raise ValueError(decision)
    if records.where(F.col("verification_id") == verification_id).isEmpty():
        return False
    row = spark.createDataFrame([(verification_id, decision, at, decision_id)], "verification_id string, decision string, at string, decision_id long")
    append(row.withColumn("at", F.to_timestamp("at")), path)
    return True


def append_self_test(spark: SparkSession, path: str, manipulation_type: str, expected: bool, confidence: float, at: str) -> None:
    """Appends a self-test: detected from 70 percent on, correct if that was expected; the confidence is the detector's own."""
    detected = confidence >= 70
    row = spark.createDataFrame([(manipulation_type, expected, detected, float(confidence), detected == expected, at)], "manipulation_type string, expected_detection boolean, predicted_detection boolean, confidence double, correct boolean, created_at string")
    append(row.withColumn("created_at", F.to_timestamp("created_at")), path)


def self_test_history(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The latest self-tests, newest first."""
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "manipulation_type").limit(limit)


def seed_if_empty(spark: SparkSession, path: str, rows: list, schema: str) -> DataFrame:
    """The table at ``path``, written from ``rows`` only if it isn't there or is empty."""
    from pyspark.errors import AnalysisException

    try:
        there = spark.read.parquet(path)
        empty = there.isEmpty()
    except AnalysisException:  # no such table yet
        empty = True
    if empty:
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report_lines(scored: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, line_no, line: a text report of each score and its deductions."""
    head = scored.select("doc_id", F.lit(0).alias("line_no"), F.format_string("document %s: %d points", F.col("doc_id").cast("string"), F.col("score").cast("int")).alias("line"))
    rows = ledger.where("deduction > 0").select("doc_id", F.col("seq").cast("int").alias("line_no"), F.format_string("  -%.0f %s (%s), %.0f left", F.col("deduction").cast("double"), "code", "severity", F.col("balance").cast("double")).alias("line"))
    return head.unionByName(rows)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path)


def picture_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem and content of a folder's pictures, whatever the case of their endings."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(PICTURES))
    return files.select("path", boxes.crop_name(F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"([^/]+)\.[^./]+$", 1)).alias("stem"), "modificationTime", "content")


def known_people(pictures: DataFrame, encodings: DataFrame) -> DataFrame:
    """name, vec: the first face of each picture that has any; encodings: path, face_no, vec (from any encoder)."""
    first = encodings.groupBy("path").agg(F.min_by("vec", "face_no").alias("vec"))
    return pictures.select("path", F.col("stem").alias("name")).join(first, "path").select("name", "vec")
