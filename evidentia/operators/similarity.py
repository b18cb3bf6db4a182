"""Fingerprint comparison within families, identity search, and matching of probe vectors to known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import vectors
from evidentia.operators import pivots


def fingerprint_matches(documents: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """document_number, sibling, match (percent, one decimal): siblings of a family with a shared factor."""
    held = documents.where("family_id IS NOT NULL").select("document_number", "family_id").join(fingerprints, "document_number")
    other = held.select("family_id", F.col("document_number").alias("sibling"), F.col("fingerprint").alias("other"))
    pairs = held.join(other, "family_id").where("document_number <> sibling")
    similarity = vectors.factor_similarity(F.col("fingerprint"), F.col("other"))
    return pairs.select("document_number", "sibling", similarity.alias("similarity")).where("similarity IS NOT NULL").select("document_number", "sibling", F.round(F.col("similarity") * 100, 6).alias("match"))


def ranked_matches(matches: DataFrame) -> DataFrame:
    """``fingerprint_matches`` with rank: a document's siblings by falling match, the smaller number first on a tie."""
    order = Window.partitionBy("document_number").orderBy(F.desc("match"), "sibling")
    return matches.withColumn("rank", F.row_number().over(order))


def fingerprint_profile(documents: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """document_number, similarity_score (own mean in percent), factors, n_related, summary, for every document.

    n_related counts the siblings of a family that share a factor. It is summed over the family's distinct sets of
    factors, so no pair of documents is ever made.
    """
    rows = documents.select("document_number", "family_id").join(fingerprints, "document_number", "left")
    held = rows.withColumn("keys", F.array_sort(F.map_keys("fingerprint")))
    sets = held.where("family_id IS NOT NULL AND size(keys) > 0").groupBy("family_id", "keys").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("keys", "other")
    shared = F.when(F.arrays_overlap("keys", "other"), F.col("n") - F.when(F.col("keys") == F.col("other"), 1).otherwise(0)).otherwise(0)
    related = held.where("size(keys) > 0").join(sets, "family_id").groupBy("document_number").agg(F.sum(shared).alias("n_related"))
    values = F.map_values("fingerprint")
    mean = F.aggregate(values, F.lit(0.0), lambda t, x: t + x) / F.size(values)
    percent = lambda x: F.bround(F.round(x * 100, 6), 1)
    said = F.transform(F.array_sort(F.map_entries("fingerprint")), lambda e: F.concat(e["key"], F.lit(" "), percent(e["value"]).cast("decimal(6,1)").cast("string")))
    out = rows.join(related, "document_number", "left").withColumn("n_related", F.coalesce("n_related", F.lit(0)))
    none = F.coalesce(F.size("fingerprint"), F.lit(0)) <= 0
    summary = F.when(none, "No structural fingerprint.").when(F.col("n_related") > 0, F.concat(F.lit("Structural pattern shared with documents: "), F.col("n_related").cast("string"), F.lit("."))).otherwise("No document shares the structural pattern.")
    return out.select("document_number", F.when(none, 0.0).otherwise(percent(mean)).alias("similarity_score"), F.when(none, "").otherwise(F.array_join(said, ", ")).alias("factors"), "n_related", summary.alias("summary"))


def identity_search(queries: DataFrame, candidates: DataFrame, k: int, show: float, review: float) -> DataFrame:
    """query_id, rank, identity_id, similarity (4 decimals), requires_review: the k best of each query at ``show`` or more.

    queries: (query_id, query_vec); candidates: (identity_id, vec), ids of whole numbers. Thresholds meet unrounded
    values. A vector that is null, empty or has a component that isn't a finite number takes no part.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "identity_id")
    ranked = pivots.near(queries, candidates, True, show, k, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "identity_id", F.round(F.greatest("score", F.lit(0.0)), 4).alias("similarity"), (F.col("score") >= review).alias("requires_review"))


def threshold_matches(probes: DataFrame, known: DataFrame, tolerance: float) -> DataFrame:
    """probe_id, known_id, distance: every known vector within the tolerance, or one row of unknown (null)."""
    out = probes.select("query_id").join(pivots.near(probes, known, False, tolerance), "query_id", "left")
    return out.select(F.col("query_id").alias("probe_id"), F.coalesce(F.col("identity_id").cast("string"), F.lit("unknown")).alias("known_id"), F.round("score", 6).alias("distance"))


def best_match(probes: DataFrame, known: DataFrame, tolerance: float) -> DataFrame:
    """probe_id, known_id (unknown beyond the tolerance, no_persons_found without any known vector), distance to the nearest, the smaller id on a tie."""
    best = pivots.near(probes, known, False, None, 1).groupBy("query_id").agg(F.min(F.struct("score", "identity_id")).alias("b"))
    rows = probes.select("query_id").join(best, "query_id", "left")
    name = F.when(F.col("b").isNull(), "no_persons_found").when(F.col("b.score") <= tolerance, F.col("b.identity_id").cast("string")).otherwise("unknown")
    return rows.select(F.col("query_id").alias("probe_id"), name.alias("known_id"), F.round("b.score", 6).alias("distance"))
