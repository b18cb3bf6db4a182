"""Between reading and rules: which type a document is tried as, and one resolved record from all its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.scoring import UNKNOWN_TYPE

# Names that mean the same field, in order of preference.
ALIASES = {
    "document_number": ["document_number", "doc_number", "id_number", "passport_number", "aadhaar_number", "pan_number", "licence_number", "uid"],
    "name": ["name"],
    "nationality": ["nationality", "country"],
    "date_of_birth": ["date_of_birth", "dob"],
    "issue_date": ["issue_date"],
    "expiry_date": ["expiry_date", "date_of_expiry"],
    "gender": ["gender", "sex"],
}
# Sources in order of preference, and the confidence of a record by the machine-readable part it has.
SOURCES = ["template", "visual", "ocr", "barcode", "mrz"]
# What a menu's choice forces and leaves out.
MODES = [("auto", None, False, False), ("passport", "passport", False, True), ("aadhaar", "aadhaar", True, False), ("pan_card", "pan_card", True, True), ("driving_license", "driving_license", True, False)]


def resolve(fields: DataFrame) -> DataFrame:
    """doc_id and one column for each field of ALIASES, gender and confidence; fields: doc_id, name, value, source, confidence.

    Of the names that mean one field the preferred source's first alias wins; blanks count as missing. A name that
    wasn't read whole is put together from its parts. An unknown sex is null. The confidence is the mean of the positive
    ones, 0.85 without any.
    """
    spark = fields.sparkSession
    names = spark.createDataFrame([(a, field, k) for field, aliases in ALIASES.items() for k, a in enumerate(aliases)] + [(n, n, 0) for n in ("given_names", "surname")], "name string, field string, alias_no int")
    order = spark.createDataFrame(list(zip(SOURCES, range(len(SOURCES)), strict=True)), "source string, source_no int")
    clean = fields.where(F.trim("value") != "").select("doc_id", F.lower("name").alias("name"), F.trim("value").alias("value"), "source", "confidence")
    ranked = clean.join(F.broadcast(names), "name").join(F.broadcast(order), "source")
    ranked = ranked.withColumn("rank", F.struct("source_no", "alias_no", "value"))
    best = lambda f: F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("rank"))).alias(f)
    out = ranked.groupBy("doc_id").agg(*(best(f) for f in [*ALIASES, "given_names", "surname"]), F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("mean"))
    whole = F.nullif(F.trim(F.concat_ws(" ", "given_names", "surname")), F.lit(""))
    sex = F.upper(F.substring("gender", 1, 1))
    return out.select("doc_id", "document_number", F.coalesce("name", whole).alias("full_name"), "nationality", "date_of_birth", "issue_date", "expiry_date", F.when(sex == "M", "Male").when(sex == "F", "Female").alias("gender"), F.round(F.coalesce("mean", F.lit(0.85)), 6).alias("confidence"))


def candidate_types(docs: DataFrame, hints: DataFrame) -> DataFrame:
    """doc_id, candidates: the forced type, then the zone's, or else the two strongest hints; none twice, never unknown.

    docs: doc_id, forced, zone_type (null without a zone); hints: doc_id, document_type, score, order (settles ties).
    """
    top = hints.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "order"))).where(F.col("rank") <= 2)
    top = top.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "document_type"))), lambda x: x["document_type"]).alias("hinted"))
    rows = docs.join(top, "doc_id", "left")
    read = F.when(F.col("zone_type").isNotNull(), F.array("zone_type")).otherwise(F.coalesce("hinted", F.array().cast("array<string>")))
    every = F.filter(F.concat(F.array("forced"), read), lambda x: x.isNotNull() & (x != "unknown"))
    return rows.select("doc_id", F.array_join(F.array_distinct(every), ",").alias("candidates"))


def with_degraded(docs: DataFrame, results: DataFrame) -> DataFrame:
    """results (doc_id, document_type, score) and for every other document a row of type unknown with score 0, never a stand-in."""
    rows = docs.select("doc_id").join(results, "doc_id", "left")
    lost = F.col("score").isNull()
    return rows.select("doc_id", F.coalesce("document_type", F.lit("unknown")).alias("document_type"), F.coalesce("score", F.lit(0)).cast("int").alias("score"), F.when(lost, UNKNOWN_TYPE).otherwise(0.0).alias("unknown_penalty"), lost.alias("degraded"))


def channel_modes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, mode, side) with forced_type, skip_mrz, skip_barcodes and accepted; an aadhaar back alone isn't."""
    modes = docs.sparkSession.createDataFrame(MODES, "mode string, forced_type string, skip_mrz boolean, skip_barcodes boolean")
    rows = docs.join(F.broadcast(modes), "mode", "left")
    return rows.select("doc_id", "mode", "forced_type", F.coalesce("skip_mrz", F.lit(False)).alias("skip_mrz"), F.coalesce("skip_barcodes", F.lit(False)).alias("skip_barcodes"), (~((F.col("mode") == "aadhaar") & (F.col("side") == "back"))).alias("accepted"))
