"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.barrier import settled

#: Rows of one key that go to one task.
KEY_ROWS = 1_000_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The same rows dealt by ``key`` to the session's shuffle partitions, for narrow rows of which much is computed.

    A table of few bytes is one row group, so one task would compute all of it; a count given here isn't lowered by the
    optimiser, which goes by bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def spread_join(many: DataFrame, few: DataFrame, key: str, key_rows: int = KEY_ROWS, at_most: int | None = None) -> DataFrame:
    """The inner join by ``key``; a key of over ``key_rows`` rows in ``many`` is cut to salts, for which the rows of ``few`` are repeated.

    There are at most rows / key_rows such keys, so their list is small however many rows there are. Where ``many`` has no more
    than key_rows rows in all, none is looked for; ``at_most`` says how many it has at most, where that is known.
    """
    if at_most is None:
        at_most = many.limit(key_rows + 1).count()
    if at_most <= key_rows:
        return many.join(few, key)
    counted = many.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > key_rows)
    hot = settled(counted.select(key, F.ceil(F.col("__n") / key_rows).cast("int").alias("__salts")))
    if hot.isEmpty():
        return many.join(few, key)
    salts = F.coalesce("__salts", F.lit(1))
    left = many.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*(c for c in many.columns if c != key)), salts)).drop("__salts")
    right = few.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))).drop("__salts")
    return left.join(right, [key, "__salt"]).drop("__salt")
