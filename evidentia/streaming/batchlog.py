"""An append-only log that a stream's batches enter exactly once: decisions and audit rows by ``foreachBatch``.

A batch is a folder, <generation>/batch=<number>; a batch whose folder is complete is skipped, one that broke off is written
anew, so a replay changes nothing. ``compact`` writes the next generation: all batches so far as one, with rows and batch numbers
as they were, while the old one still stands; batches up to it are known and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DECISIONS = ("CLEARED", "SECONDARY_INSPECTION", "DENIED")


class BatchLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, path: str) -> list[str]:
        """Names of the complete folders in a folder."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]

    def _generation(self) -> int:
        """The newest generation whose first folder, the compacted one, is complete; 0 without any."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        numbers = sorted((int(f.getPath().getName().removeprefix("gen=")) for f in fs.listStatus(root)), reverse=True) if fs.exists(root) else []
        return next((g for g in numbers if any(n.startswith("upto=") for n in self._folders(f"{self.path}/gen={g}"))), 0)

    def _parts(self) -> tuple[str, dict[int, str], int]:
        """(the generation's folder, its batches' folders by number, the number up to which it is compacted or -1)."""
        folder = f"{self.path}/gen={self._generation()}"
        names = self._folders(folder)
        upto = max((int(n.removeprefix("upto=")) for n in names if n.startswith("upto=")), default=-1)
        return folder, {int(n.removeprefix("batch=")): n for n in names if n.startswith("batch=")}, upto

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch's rows; false, and nothing written, if the log has that batch."""
        folder, batches, upto = self._parts()
        if batch <= upto or batch in batches:
            return False
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
        return True

    def read(self) -> DataFrame | None:
        """All rows with their batch; null while the log is empty. Folders that aren't complete are not read."""
        folder, batches, upto = self._parts()
        names = [f"{folder}/{n}" for n in batches.values()] + ([f"{folder}/upto={upto}"] if upto >= 0 else [])
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*names) if names else None

    def compact(self, rows_per_file: int = 1_000_000) -> None:
        """One folder for all batches so far, in a new generation."""
        folder, batches, upto = self._parts()
        rows = self.read()
        if not batches or rows is None:
            return
        files = max(1, -(-rows.count() // rows_per_file))
        rows.repartition(files).write.mode("overwrite").parquet(f"{self.path}/gen={int(folder.rsplit('=', 1)[1]) + 1}/upto={max(batches)}")


def decide(decisions: DataFrame, records: DataFrame, log: BatchLog, rejected: BatchLog, batch: int) -> None:
    """A batch of decisions (verification_id, decision, at, decision_id) into the log, those of unknown records or words into ``rejected``.

    One join with the records tells for the whole batch; a decision that stands twice in the batch enters once.
    """
    rows = decisions.dropDuplicates(["decision_id"])
    known = rows.join(records.select("verification_id").distinct().withColumn("known", F.lit(True)), "verification_id", "left")
    why = F.when(F.col("known").isNull(), "no such record").when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "no such decision")
    judged = known.withColumn("why", why).drop("known").persist()
    log.write(judged.where("why IS NULL").drop("why"), batch)
    rejected.write(judged.where("why IS NOT NULL"), batch)
    judged.unpersist()
