"""Alerts by keyed state: batches in any order, a restart in the middle and repeated events give the batch query's alerts."""

import random

import pytest

from evidentia.operators import registry
from evidentia.streaming import alerts

SCHEMA = "event_id long, identity_id long, checkpoint string, risk_level string, ts timestamp"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", alerts.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, tmp, held, idle_ms=None):
    """Everything in the folder that isn't done yet, as one query that ends; a later call goes on from its checkpoint."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp / "in"))
    out = lambda rows, n: rows.write.mode("overwrite").parquet(str(tmp / f"out/batch={n}"))
    q = alerts.group_alerts(stream, held, idle_ms, "0 seconds").writeStream.foreachBatch(out).outputMode("update").option("checkpointLocation", str(tmp / "state")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return spark.read.parquet(str(tmp / "out"))


def test_any_order_and_a_restart(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    docs = [(n, rng.randrange(12), rng.choice([1, 2, 3, None])) for n in range(24)]
    documents = spark.createDataFrame(docs, "document_number long, identity_id long, family_id long")
    held = documents.where("family_id IS NOT NULL").select("identity_id", "family_id").distinct()
    people = spark.range(14).withColumnRenamed("id", "identity_id")
    rows = [(n, rng.randrange(14), rng.choice("ABCD"), rng.choice(["LOW", "LOW", "LOW", "HIGH"])) for n in range(24)]
    events = spark.createDataFrame(rows, "event_id long, identity_id long, checkpoint string, risk_level string").selectExpr("*", "timestamp_seconds(1000000000 + event_id * 60) AS ts")
    want = {(r.identity_id, r.total_checkpoints, r.alert) for r in registry.cluster_alerts(people, documents, events).collect()}
    assert len({w[2] for w in want}) == 2
    parts = [list(range(k, 24, 4)) for k in range(4)] + [[3, 7]]  # the last repeats events
    for k, order in enumerate(([2, 0, 4, 3, 1], [1, 3, 0, 2, 4])):
        tmp = tmp_path / str(k)
        for n, part in enumerate(order):
            events.where(events.event_id.isin(parts[part])).coalesce(1).write.mode("append").parquet(str(tmp / "in"))
            if n in (1, 4):  # ends, and starts again from what it kept
                groups = run(spark, tmp, held)
        got = {(r.identity_id, r.total_checkpoints, r.alert) for r in alerts.by_identity(alerts.latest(groups), people, held).collect()}
        assert got == want


def test_idle_groups_are_closed(rocks, tmp_path):
    spark = rocks
    held = spark.createDataFrame([(1, 7)], "identity_id long, family_id long")
    for n, (who, at) in enumerate([(1, 1_000), (2, 5_000), (2, 5_900)]):
        spark.createDataFrame([(n, who, "A", "HIGH", at)], "event_id long, identity_id long, checkpoint string, risk_level string, at long").selectExpr("event_id", "identity_id", "checkpoint", "risk_level", "timestamp_seconds(at) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        groups = run(spark, tmp_path, held, idle_ms=1000 * 1000)
    assert {r.group for r in groups.where("closed").collect()} >= {"identity:1", "family:7"}
    assert {r.group for r in alerts.latest(groups).collect()} == {"identity:2"}
