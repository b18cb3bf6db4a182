"""Checkpoint alerts on a stream of events, with keyed state: each family's checkpoints, and whether an event there was risky.

An event goes to its identity's own group and, by a join with the static table of identities and families, to each of its
families. A group's state is a map from checkpoint to risk; a row is sent when the map says something new, so a repeated event
or a replayed batch changes nothing and the order of batches doesn't matter. ``latest`` keeps the last row of a group, and
``by_identity`` has of each identity what the batch operator ``registry.cluster_alerts`` has. A group without events
for ``idle`` (by event time, against the watermark) is closed by a timer and forgotten.

The state store must be RocksDB: ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RISKY = ("MEDIUM", "HIGH")
GROUP = "group string, checkpoints array<string>, risky boolean, version long, closed boolean"


def grouped_events(events: DataFrame, held: DataFrame) -> DataFrame:
    """(group, checkpoint, risky, ts) of events (identity_id, checkpoint, risk_level, ts): a row for the identity, and for each family that ``held`` (identity_id, family_id) gives it."""
    families = held.groupBy("identity_id").agg(F.collect_set(F.concat(F.lit("family:"), F.col("family_id").cast("string"))).alias("families"))
    rows = events.join(families, "identity_id", "left")
    own = F.array(F.concat(F.lit("identity:"), F.col("identity_id").cast("string")))
    groups = F.concat(own, F.coalesce("families", F.array().cast("array<string>")))
    return rows.select(F.explode(groups).alias("group"), "checkpoint", F.col("risk_level").isin(*RISKY).alias("risky"), "ts")


class Checkpoints(StatefulProcessor):
    """The state of one group: checkpoint to risky, and how often it said something new."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "checkpoint string", "risky boolean")
        self.version = handle.getValueState("version", "n long")
        self.due = handle.getValueState("due", "at long")

    def _row(self, group: str, version: int, closed: bool) -> pd.DataFrame:
        held = {k[0]: v[0] for k, v in self.seen.iterator()}
        return pd.DataFrame({"group": [group], "checkpoints": [sorted(held)], "risky": [any(held.values())], "version": [version], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        told, latest = False, None
        for frame in rows:
            for checkpoint, risky in frame.groupby("checkpoint", dropna=True)["risky"].max().items():
                there = self.seen.containsKey((checkpoint,))
                if not there or (risky and not self.seen.getValue((checkpoint,))[0]):
                    self.seen.updateValue((checkpoint,), (bool(risky),))
                    told = True
            latest = max(x for x in (latest, frame["ts"].max()) if x is not None)
        if self.idle_ms is not None and latest is not None:
            at = int(latest.timestamp() * 1000) + self.idle_ms
            before = self.due.get()[0] if self.due.exists() else None
            if before is None or at > before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(at)
                self.due.update((at,))
        if told:
            version = (self.version.get()[0] if self.version.exists() else 0) + 1
            self.version.update((version,))
            yield self._row(key[0], version, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        yield self._row(key[0], version, True)
        self.seen.clear()
        self.version.update((version,))
        self.due.clear()

    def close(self) -> None:
        pass


def group_alerts(events: DataFrame, held: DataFrame, idle_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """A stream of groups whose checkpoints or risk changed: group, checkpoints (sorted), risky, version, closed."""
    timed = events if idle_ms is None else events.withWatermark("ts", late)
    rows = grouped_events(timed, held)
    mode = "None" if idle_ms is None else "EventTime"
    return rows.groupBy("group").transformWithStateInPandas(Checkpoints(idle_ms), outputStructType=GROUP, outputMode="Update", timeMode=mode)


def latest(groups: DataFrame) -> DataFrame:
    """group, checkpoints, risky: of each group's rows the last version, without those that are closed."""
    last = groups.groupBy("group").agg(F.max_by(F.struct("checkpoints", "risky", "closed"), "version").alias("g"))
    return last.where("NOT g.closed").select("group", "g.checkpoints", "g.risky")


def by_identity(groups: DataFrame, identities: DataFrame, held: DataFrame, least_checkpoints: int = 2) -> DataFrame:
    """identity_id, total_checkpoints, alert, from the ``latest`` groups of an identity and its families."""
    own = identities.select("identity_id", F.concat(F.lit("identity:"), F.col("identity_id").cast("string")).alias("group"))
    of = held.select("identity_id", F.concat(F.lit("family:"), F.col("family_id").cast("string")).alias("group"))
    met = own.unionByName(of).join(groups, "group").select("identity_id", F.explode("checkpoints").alias("checkpoint"), "risky")
    found = met.groupBy("identity_id", "checkpoint").agg(F.max("risky").alias("risky")).groupBy("identity_id").agg(F.count(F.lit(1)).alias("n"), F.max("risky").alias("risky"))
    out = identities.select("identity_id").join(found, "identity_id", "left").withColumn("total_checkpoints", F.coalesce("n", F.lit(0)))
    return out.select("identity_id", "total_checkpoints", ((F.col("total_checkpoints") >= least_checkpoints) & F.coalesce("risky", F.lit(False))).alias("alert"))
