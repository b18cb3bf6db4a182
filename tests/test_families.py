"""Families and clusters by sums, against clusters member by member; a family with most documents."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import skew
from evidentia.operators import registry


def totals(held, events, people, least=2):
    """Each identity's cluster taken apart."""
    families = {}
    for i, f in held:
        families.setdefault(f, set()).add(i)
    out = {}
    for i in people:
        members = {i} | {j for f, m in families.items() if i in m for j in m}
        seen = [(c, r) for j, c, r in events if j in members]
        points = {c for c, _ in seen}
        out[i] = (len(points), len(seen), len(points) >= least and any(r != "LOW" for _, r in seen))
    return out


@pytest.mark.parametrize("subsets", [6, 2, 0])
def test_cluster_alerts(spark, subsets):
    rng = random.Random(3)
    held = [(i, rng.randrange(25)) for i in range(60) for _ in range(rng.choice([0, 1, 1, 2, 3, 7]))] + [(i, 99) for i in range(0, 60, 3)]
    docs = [(n, i, f) for n, (i, f) in enumerate(held)] + [(1000, 1, None), (1001, None, 4)]
    events = [(rng.randrange(70), rng.choice("ABCDE"), rng.choice(["LOW", "LOW", "MEDIUM", "HIGH"])) for _ in range(150)]
    frames = spark.createDataFrame([(i,) for i in range(65)], "identity_id int"), spark.createDataFrame(docs, "document_number int, identity_id int, family_id int"), spark.createDataFrame(events, "identity_id int, checkpoint string, risk_level string")
    got = {r.identity_id: (r.total_checkpoints, r.total_appearances, r.alert) for r in registry.cluster_alerts(*frames, subsets=subsets).collect()}
    assert got == totals(held, events, range(65))


def test_a_family_of_50000(spark):
    """One family holds nearly all documents: alerts, pages and look-ups stay linear, salted or not."""
    n = 50_000
    docs = spark.range(n + 100).select(F.col("id").alias("document_number"), (F.col("id") % 49_000).alias("identity_id"), F.when(F.col("id") < n, F.lit(7)).otherwise(F.col("id")).alias("family_id"))
    people = spark.range(49_500).select(F.col("id").alias("identity_id"))
    events = spark.range(3000).select((F.col("id") * 16).alias("identity_id"), F.concat(F.lit("C"), F.col("id") % 5).alias("checkpoint"), F.when(F.col("id") == 5, "HIGH").otherwise("LOW").alias("risk_level"))
    got = registry.cluster_alerts(people, docs, events)
    assert got.groupBy("total_checkpoints", "total_appearances", "alert").count().collect() and got.where("identity_id < 49000 AND total_appearances >= 3000 AND total_checkpoints = 5 AND alert").count() == 49_000
    families = spark.createDataFrame([(7, "hot")], "family_id long, common_pattern string")
    pages = registry.family_members(docs, families).collect()
    assert len(pages) == 50 and {r.n_members for r in pages} == {n} and sum(len(r.members.split(",")) for r in pages) == n and max(len(r.members.split(",")) for r in pages) <= 1001
    assert [int(x) for r in sorted(pages, key=lambda r: r.page) for x in r.members.split(",")] == list(range(n))
    assert registry.family_of_document(docs, families).count() == n
    assert registry.members_of(docs.where("document_number IN (3, 50050)"), docs).groupBy("document_number").count().orderBy("document_number").collect() == [(3, n), (50050, 1)]


def test_each_document_has_its_whole_family(spark):
    """More members than a page holds, a family that isn't listed, and documents without one."""
    docs = spark.range(2603).select(F.col("id").alias("document_number"), F.when(F.col("id") < 2500, 7).when(F.col("id") < 2600, 8 + F.col("id") % 2).when(F.col("id") == 2600, 11).alias("family_id"))
    families = spark.createDataFrame([(7, "hot"), (8, "even"), (9, None), (12, "empty")], "family_id long, common_pattern string")
    got = {r.document_number: r for r in registry.members_by_document(docs, families).collect()}
    assert sorted(got) == list(range(2600))
    for n, r in got.items():
        want = range(2500) if n < 2500 else range(2500 + n % 2, 2600, 2)
        assert r.members == ",".join(map(str, want)) and r.n_members == len(want) and r.family_id == (7 if n < 2500 else 8 + n % 2) and r.common_pattern == {7: "hot", 8: "even", 9: None}[r.family_id]


def test_spread_join(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    few = spark.range(0, 5000, 10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(0, -1)], "k long, v long"))
    plain, spread = many.join(few, "k"), skew.spread_join(many, few, "k", key_rows=100)
    assert spread.columns == plain.columns and sorted(map(tuple, spread.collect())) == sorted(map(tuple, plain.collect()))
