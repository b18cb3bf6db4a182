"""Barriers for the optimiser: expensive columns and tables that much is built on are computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame) -> DataFrame:
    """The same rows through a one-element array: projections aren't merged across it, so no expression is copied."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, computed once into the folder of spark.checkpoint.dir.

    Where that is unset, a local session has a folder of its own; on a cluster, where such a folder isn't shared, it is an error.
    """
    sc = rows.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
    return rows.checkpoint()
