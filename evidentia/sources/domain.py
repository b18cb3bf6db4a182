"""Domain views over the driver's tables: identities, documents, families, checkpoint events, fingerprints, cards.

Every number made here is synthetic and can't be issued: 12-digit numbers begin with 0, and the state is UTO.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import checkdigits, skew
from evidentia.functions.barrier import once

REFERENCE_DATE = "2026-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity_id, name, nationality, dealt to tasks."""
    people = skew.spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity_id"), F.col("c_name").alias("name"), "c_nationkey"), "identity_id")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nationality"))
    return people.join(nations, people.c_nationkey == nations.n_nationkey, "left").select("identity_id", "name", "nationality")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity_id, name, nationality, embedding (null for most)."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("identity_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return people(spark, sf_dir).join(vectors, "identity_id", "left").select("identity_id", "name", "nationality", "embedding")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_number, family_id: an order's least supplier among its returned lines of 49 or more."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 49")
    return lines.groupBy(F.col("l_orderkey").alias("document_number")).agg(F.min("l_suppkey").alias("family_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_number, identity_id, issue_date, expiry_date, status, family_id."""
    status = F.when(F.col("o_orderstatus") == "F", "VALID").when(F.col("o_orderstatus") == "O", "EXPIRED").when(F.col("o_orderstatus") == "P", "BLACKLISTED")
    issued = F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_number"), F.col("o_custkey").alias("identity_id"), issued.alias("issue_date"), F.add_months(issued, 120).alias("expiry_date"), status.alias("status"))
    return orders.join(memberships(spark, sf_dir), "document_number", "left")


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("family_id"), F.col("s_name").alias("common_pattern"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, identity_id, checkpoint, risk_level, ts."""
    risk = F.when(F.col("value") < 60, "LOW").when(F.col("value") < 200, "MEDIUM").otherwise("HIGH")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("identity_id"), F.col("event_type").alias("checkpoint"), risk.alias("risk_level"), "ts")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_number, fingerprint: a map of factors in 0 to 1; a document of few lines has fewer factors."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_number"))
    found = lines.agg(F.max(F.col("l_discount") + 0.0).alias("font"), F.max(F.col("l_tax") + 0.0).alias("layout"), F.max("l_quantity").alias("dimensions"), F.min(F.col("l_discount") + 0.0).alias("compression"), F.count(F.lit(1)).alias("n"))
    factors = F.create_map(F.lit("font"), F.col("font") * 10, F.lit("layout"), F.col("layout") * 10, F.lit("dimensions"), F.col("dimensions") / 50, F.lit("compression"), F.when(F.col("n") > 3, F.col("compression") * 10))
    return found.select("document_number", F.map_filter(factors, lambda k, v: v.isNotNull()).alias("fingerprint"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, dealt to tasks: all that is made of a card is made of its key."""
    return skew.spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


def card_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain columns of ``cards``: key, number, birth, expiry, sex, surname, given_names."""
    k = F.col("c_custkey")
    birth = F.date_add(F.lit("1950-01-01").cast("date"), (k * 37 % 20000).cast("int"))
    expiry = F.date_add(F.lit("2015-01-01").cast("date"), (k * 53 % 9000).cast("int"))
    number = F.concat(F.lit("L"), F.lpad(k.cast("string"), 8, "0"))
    given = F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ")
    sex = F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("<")
    return customers(spark, sf_dir).select(k.alias("key"), number.alias("number"), birth.alias("birth"), expiry.alias("expiry"), sex.alias("sex"), F.lit("CUSTOMER").alias("surname"), given.alias("given_names"))


def cards(spark: SparkSession, sf_dir: str, zone: bool = True, numbers: bool = True) -> DataFrame:
    """One synthetic card for each customer: key, mrz1, mrz2 (TD3), number, birth, expiry, sex, surname, given_names, uid, pan.

    Where key % 7 = 0 a digit of the machine-readable number and of the uid is altered after its check was made. Columns that
    aren't used are computed all the same, so mrz1 and mrz2 are left out without ``zone``, uid and pan without ``numbers``.
    """
    base = card_base(spark, sf_dir)
    digit = checkdigits.mrz_check_digit
    b, e, n = F.date_format("birth", "yyMMdd"), F.date_format("expiry", "yyMMdd"), F.col("number")
    personal = F.rpad(F.concat(F.lit("ZE"), F.lpad((F.col("key") % 1000).cast("string"), 4, "0")), 14, "<")
    stem = F.lpad((F.col("key") * 7919 % 100000000).cast("string"), 11, "0")
    pan9 = F.concat(F.lit("ALK"), F.substring(F.lit("CPHFATBLJGXZ"), (F.col("key") % 12).cast("int") + 1, F.lit(1)), F.substring(F.lit("CQ"), (F.col("key") % 2).cast("int") + 1, F.lit(1)), F.lpad((F.col("key") * 31 % 10000).cast("string"), 4, "0"))
    of_zone = {"p1": F.concat(n, digit(n)), "p2": F.concat(b, digit(b)), "p3": F.concat(e, digit(e), personal, digit(personal))}
    of_numbers = {"uid0": F.concat(stem, checkdigits.verhoeff_check_digit(stem)), "pan9": pan9}
    parts = once(base.withColumns((of_zone if zone else {}) | (of_numbers if numbers else {})))
    composite = digit(F.concat("p1", "p2", "p3"))
    altered = F.col("key") % 7 == 0
    other = ((F.substring("p1", 9, 1).cast("int") + 1) % 10).cast("string")
    p1 = F.when(altered, F.concat(F.substring("p1", 1, 8), other, F.substring("p1", 10, 1))).otherwise(F.col("p1"))
    line2 = F.concat(p1, F.lit("UTO"), F.col("p2"), F.col("sex"), F.col("p3"), composite)
    line1 = F.rpad(F.concat(F.lit("P<UTO"), F.col("surname"), F.lit("<<"), F.col("given_names")), 44, "<")
    uid = F.col("uid0")
    flipped = F.concat(F.substring(uid, 1, 4), ((F.substring(uid, 5, 1).cast("int") + 1) % 10).cast("string"), F.substring(uid, 6, 7))
    pan = F.concat("pan9", F.when(F.col("key") % 5 == 0, "Q").otherwise(checkdigits.mod36_check_char(F.col("pan9"))))
    made = ({"mrz1": line1, "mrz2": line2} if zone else {}) | ({"uid": F.when(altered, flipped).otherwise(uid), "pan": pan} if numbers else {})
    return once(parts.withColumns(made).drop("p1", "p2", "p3", "uid0", "pan9"))
