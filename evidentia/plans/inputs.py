"""Inputs that the rules and the screening plan share, made from the cards and the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources import domain


FACE_STATES = ("SUCCESS", "NO_FACE_DETECTED", "MULTIPLE_FACES", "LOW_QUALITY", "SUCCESS", "INVALID_IMAGE", "ALIGNMENT_FAILED", "SUCCESS", "SUCCESS")


def _date_texts(c: DataFrame) -> DataFrame:
    """The cards with birth, issue and expiry as texts in many layouts, some of them wrong or blank: b, i, e."""
    k = F.col("key")
    b = F.when(k % 8 == 0, F.date_format("birth", "yyyy-MM-dd")).when(k % 8 == 1, F.date_format("birth", "d/M/yyyy")).when(k % 8 == 2, F.date_format("birth", "dd-MM-yyyy")).when(k % 8 == 3, F.date_format("birth", "yyyy/MM/dd")).when(k % 8 == 4, F.date_format("birth", "dd.MM.yyyy")).when(k % 8 == 5, "31/02/1995").when(k % 8 == 6, "").otherwise("2035-06-01")
    i = F.when(k % 5 == 0, "").when(k % 5 == 1, F.date_format(F.date_sub("expiry", 3650), "yyyy-MM-dd")).when(k % 5 == 2, "1940-01-01").when(k % 5 == 3, "2040-02-02").otherwise(F.date_format(F.date_add("expiry", 5), " dd/MM/yyyy "))
    e = F.when(k % 6 == 0, "not-a-date").when(k % 6 == 1, domain.REFERENCE_DATE).otherwise(F.date_format("expiry", "yyyy-MM-dd"))
    return c.withColumns({"b": b, "i": i, "e": e})


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, birth, issue, expiry as texts in many layouts, some of them wrong or blank."""
    return _date_texts(domain.card_base(spark, sf_dir)).select(F.col("key").alias("doc_id"), F.col("b").alias("birth"), F.col("i").alias("issue"), F.col("e").alias("expiry"))


def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the field validator reads of each card: some numbers altered, some fields missing, dates in many layouts."""
    c = _date_texts(domain.cards(spark, sf_dir, zone=False))
    k = F.col("key")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("Passport", "Aadhaar", "PAN", "National ID", "Visa"))), (k % 5 + 1).cast("int"))
    number = F.when(k % 5 == 1, F.concat_ws(" ", F.substring("uid", 1, 4), F.substring("uid", 5, 4), F.substring("uid", 9, 4))).when(k % 5 == 2, F.col("pan")).when(k % 5 == 3, F.concat(F.lit("ID-"), F.col("key").cast("string"))).otherwise(F.col("number"))
    return c.select(k.alias("doc_id"), kind.alias("document_type"), F.col("given_names").alias("name"), number.alias("document_number"), F.when(k % 6 != 0, "UTO").alias("nationality"), F.col("b").alias("date_of_birth"), F.col("i").alias("issue_date"), F.col("e").alias("expiry_date"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, the forensic signals ela, edge_density, blur and bias of each image, and what a face detector said of it: face_status, face_count."""
    k = F.col("p_partkey")
    return domain.table(spark, sf_dir, "part").select(k.alias("image_id"), (k % 13 * 1.0).alias("ela"), (k % 7 * 0.01).alias("edge_density"), (k % 11 * 10.0).alias("blur"), (k % 50 / 50.0).alias("bias"), F.element_at(F.array(*(F.lit(x) for x in FACE_STATES)), (k % len(FACE_STATES) + 1).cast("int")).alias("face_status"), F.when(k % len(FACE_STATES) == 2, k % 3 + 2).otherwise(1).cast("int").alias("face_count"))
