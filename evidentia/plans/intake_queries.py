"""Queries of the intake operators and of single identities' graphs; ``evidentia.plans.intake_oracle`` has their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import mrz, payloads, vectors
from evidentia.functions.barrier import once
from evidentia.operators import intake, registry, rules, similarity
from evidentia.plans import catalogue_queries as base
from evidentia.plans import inputs
from evidentia.sources import domain


def barcode_channels(spark, sf_dir):
    return intake.barcode_channels(base._decodes(spark, sf_dir)).select("doc_id", "seq", "format", "text", "channel", "first_of_channel")


def barcode_fields(spark, sf_dir):
    return intake.barcode_fields(intake.barcode_parts(intake.barcode_channels(base._decodes(spark, sf_dir))))


def two_sided_lines(spark, sf_dir):
    lines = base._lines(spark, sf_dir)
    return intake.pool_sides(lines.where("line_no < 6"), lines.where("line_no >= 6"))


def field_cleaners(spark, sf_dir):
    c = base._cards(spark, sf_dir)
    k = F.col("key")
    read = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    spaced = F.concat_ws(" ", F.substring("uid", 1, 4), F.substring("uid", 5, 4), F.substring("uid", 9, 4))
    rows = F.array(read("document_number", F.when(k % 2 == 0, spaced).otherwise(F.concat(F.lower("number"), F.lit("<<")))), read("date_of_birth", F.when(k % 3 == 0, " 1 1 ").otherwise(F.concat(F.lit("DOB: "), F.date_format("birth", "d/M/yyyy"), F.lit(" x")))), read("sex", F.when(k % 3 == 0, "Sex: female").when(k % 3 == 1, " x ").otherwise("m")), read("surname", F.concat(F.lit(" "), "surname")))
    return intake.clean_fields(c.select(k.alias("doc_id"), F.explode(rows).alias("f")).select("doc_id", "f.*"))


def passport_in_lines(spark, sf_dir):
    return intake.passport_numbers(base._lines(spark, sf_dir))


def reading_confidence(spark, sf_dir):
    k = F.col("doc_id")
    docs = base._docs(spark, sf_dir).select("doc_id", (k % 3 == 0).alias("has_barcode"), (k % 2 == 0).alias("has_mrz"))
    fields = base._fields(spark, sf_dir).where(k % 4 != 1).withColumn("confidence", F.when(k % 7 == 0, 0.0).otherwise(F.col("confidence")))
    return intake.reading_confidence(docs, fields)


def weighted_angle(spark, sf_dir):
    """Segments made of the lines of orders."""
    line = domain.table(spark, sf_dir, "lineitem")
    x1, y1 = F.col("l_linenumber") * 3.0, F.col("l_suppkey") % 17 * 1.0
    return intake.weighted_angles(line.select(F.col("l_orderkey").alias("image_id"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_partkey") % 60 - 30.0).alias("x2"), (y1 + F.col("l_quantity").cast("double") - 20.0).alias("y2"))).select("image_id", F.round("angle", 6).alias("angle"))


def demo_signals(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("image_id"), F.round(intake.byte_bias(F.col("c_name").cast("binary")), 6).alias("bias"), intake.hash_pick(F.col("c_name")).alias("picked"))


def mrz_parse_any(spark, sf_dir):
    """TD3, TD2 and TD1 lines of every card, with blank lines between, some short or with a character outside the set."""
    td3 = base._cards(spark, sf_dir).select("key", F.array(F.col("mrz1"), F.lit(" "), F.when(F.col("key") % 5 == 0, F.substring("mrz2", 1, 42)).otherwise(F.col("mrz2"))).alias("lines"))
    td2 = base._td2(spark, sf_dir).select("key", F.array(F.lit(""), F.col("a1"), F.when(F.col("key") % 6 == 0, F.lower("a2")).otherwise(F.concat("a2", F.lit("  ")))).alias("lines"))
    td1 = base._td1(spark, sf_dir).select("key", F.array("a1", "a2", "a3").alias("lines"))
    rows = once(td3.withColumn("form", F.lit(3)).unionByName(td2.withColumn("form", F.lit(2))).unionByName(td1.withColumn("form", F.lit(1))))
    return mrz.parse_any_rows(rows)


def expiry_days(spark, sf_dir):
    return rules.expiry_days(inputs.date_texts(spark, sf_dir), base.REF)


def json_inputs(spark, sf_dir):
    """Vectors and fingerprints through JSON texts and back, with texts that aren't any."""
    f = domain.fingerprints(spark, sf_dir)
    text = F.when(F.col("document_number") % 5 == 0, "no json").when(F.col("document_number") % 5 == 1, "[]").otherwise(F.to_json("fingerprint"))
    factors = payloads.json_factors(text)
    total = F.aggregate(F.map_values(factors), F.lit(0.0), lambda s, x: s + x)
    vector = payloads.json_vector(F.to_json(F.array(F.map_values("fingerprint")[0])))
    return f.select("document_number", F.round(total / F.size(factors), 6).alias("mean"), F.round(vector[0], 6).alias("first"))


def face_verification(spark, sf_dir):
    rows = domain.identities(spark, sf_dir).select("identity_id", vectors.pseudo_embedding(F.col("name")).alias("v"), vectors.pseudo_embedding(F.col("nationality")).alias("w"))
    score = F.round(F.round(vectors.face_score(vectors.cosine(F.col("v"), F.col("w"))), 9), 3)
    return once(rows.select("identity_id", score.alias("similarity_score"))).select("identity_id", "similarity_score", (F.col("similarity_score") >= 0.72).alias("match"), vectors.face_confidence(F.col("similarity_score")).alias("confidence"))


def fingerprint_ranked(spark, sf_dir):
    return similarity.ranked_matches(base.fingerprint_similarity(spark, sf_dir))


def graph_neighbourhood(spark, sf_dir):
    """The graphs of the identities that hold a blacklisted document."""
    given = domain.documents(spark, sf_dir).where("status = 'BLACKLISTED'").select("identity_id")
    return registry.graph_neighbourhood(given, *base._graph(spark, sf_dir))


def network_report(spark, sf_dir):
    return registry.network_report(*base._graph(spark, sf_dir))


def screening_log(spark, sf_dir):
    rows = base.risk_score_band(spark, sf_dir)
    return registry.log_lines(rows.select(F.col("identity_id").alias("verification_id"), F.col("identity_id").alias("document_number"), "risk_score", "risk_level"), "officer-1")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
