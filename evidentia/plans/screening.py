"""The screening plan: every identity's inputs from the validation, forensic, registry, cluster, fingerprint and vector operators, fused to a risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import vectors
from evidentia.functions.barrier import once, settled
from evidentia.operators import registry, rules, scoring, similarity
from evidentia.plans import inputs
from evidentia.sources import domain

LEAST_CHECKPOINTS, MATCHES, SHOW, REVIEW = 4, 3, 0.30, 0.40


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity_id, face_similarity: the cosine scale of the pseudo-embeddings of name and nationality, in place of two images."""
    nations = domain.table(spark, sf_dir, "nation").select(F.col("n_name").alias("nationality")).distinct()
    nations = once(nations.select("nationality", vectors.pseudo_embedding(F.col("nationality")).alias("w")))  # once a nation, not once an identity
    v = domain.people(spark, sf_dir).join(nations, "nationality", "left").select("identity_id", vectors.pseudo_embedding(F.col("name")).alias("v"), "w")
    return once(once(v).select("identity_id", F.round(vectors.face_score(vectors.cosine(F.col("v"), F.col("w"))), 6).alias("face_similarity")))


def risk_rows(spark: SparkSession, sf_dir: str, faces: DataFrame | None = None) -> DataFrame:
    """One row for each identity with its risk inputs and the factors f_<name>.

    An identity's screened document is the one of worst status, of these the largest number; its own status and
    fingerprint count, UNKNOWN and none without a document. Its card is validated and the image of its number is searched for
    signs of tampering. Every identity with a vector is searched among all others; one without has no matches. ``faces``:
    identity_id, face_similarity; there are no images here, so without it that factor is null.

    Identities, documents with families and validated cards are computed once, and each part says of an identity what
    the last join needs.
    """
    people, documents, ref = settled(domain.identities(spark, sf_dir).select("identity_id", "embedding")), settled(domain.documents(spark, sf_dir)), domain.REFERENCE_DATE
    worst = F.when(F.col("status") == "BLACKLISTED", 3).when(F.col("status") == "EXPIRED", 2).otherwise(1)
    screened = documents.groupBy("identity_id").agg(F.max_by(F.struct("document_number", "status"), F.struct(worst.alias("w"), "document_number")).alias("d")).select("identity_id", "d.*")
    profile = similarity.fingerprint_profile(documents, domain.fingerprints(spark, sf_dir)).select("document_number", F.col("n_related").alias("dna_related"), F.col("similarity_score").alias("dna_score"))
    screened = screened.join(profile, "document_number", "left").withColumn("status_detail", F.when(F.col("status") == "BLACKLISTED", F.concat(F.lit("listed: "), F.col("document_number").cast("string")))).drop("document_number")
    checked = rules.field_validation(inputs.validation_rows(spark, sf_dir), ref)
    codes = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    checked = settled(checked.select(F.col("doc_id").alias("identity_id"), "is_valid", codes("errors").alias("validation_errors"), F.size(codes("warnings")).alias("n_warnings")))
    tamper = scoring.forensic_status(inputs.signals(spark, sf_dir))
    tamper = tamper.select(F.col("image_id").alias("identity_id"), F.col("confidence").alias("tamper_confidence"), F.col("status").alias("tamper_status"), F.col("findings").alias("tamper_findings"), "face_status", "face_count")
    alerts = registry.cluster_alerts(people.select("identity_id"), documents, domain.events(spark, sf_dir), LEAST_CHECKPOINTS).select("identity_id", F.col("alert").alias("checkpoint_alert"))
    cases = registry.connected_cases(documents, domain.families(spark, sf_dir))
    held = people.where("embedding IS NOT NULL").select("identity_id", F.col("embedding").alias("vec"))
    queries = held.select(F.col("identity_id").alias("query_id"), F.col("vec").alias("query_vec"))
    found = similarity.identity_search(queries, held, MATCHES, SHOW, REVIEW).groupBy(F.col("query_id").alias("identity_id"))
    found = found.agg(F.count(F.lit(1)).alias("identity_matches"), F.sort_array(F.collect_list(F.struct("rank", "identity_id", "similarity"))).alias("matches"))  # at most MATCHES
    rows = people.select("identity_id")
    for part in (screened, checked, tamper, alerts, cases, found):
        rows = rows.join(part, "identity_id", "left")
    rows = rows.withColumn("face_similarity", F.lit(None).cast("double")) if faces is None else rows.join(faces.select("identity_id", "face_similarity"), "identity_id", "left")
    filled = {"status": "UNKNOWN", "dna_related": 0, "dna_score": 0.0, "checkpoint_alert": False, "connected_cases": 0, "identity_matches": 0}
    rows = rows.withColumn("face_match", F.col("face_similarity") >= 0.72).na.fill(filled)
    return scoring.risk_factors(rows)


def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity_id, risk_score, risk_level, reasons, document_hash: evidence for an officer, never a verdict."""
    rows = risk_rows(spark, sf_dir).withColumn("risk_score", scoring.risk_total())
    rows = rows.withColumn("risk_level", scoring.band(F.col("risk_score")))
    outcome = F.concat_ws(":", F.col("identity_id").cast("string"), F.col("risk_level"))
    return rows.select("identity_id", "risk_score", "risk_level", scoring.reasons().alias("reasons"), F.upper(F.sha2(outcome.cast("binary"), 256)).alias("document_hash"))
