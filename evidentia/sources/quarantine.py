"""Uploads and record files that can't be read become rows with a reason, beside what can: nothing is lost, nothing stops.

Each reader gives (good rows, rejected rows); rejected rows are (doc_id, source, place, reason, raw): the file, the byte at which the
part of it begins that a task had (null for the whole file), and the text where there is any. ``settle`` gives every document a result, a degraded one for those rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import boxes
from evidentia.functions.barrier import settled
from evidentia.operators import assemble

REJECTED = "doc_id string, source string, place long, reason string, raw string"


def stem(path: Column) -> Column:
    """A file's name without folders and ending: the id of the document that it is."""
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"([^/]+?)(\.[^./]+)?$", 1)


def _rejected(rows: DataFrame, doc_id, source, place, reason, raw) -> DataFrame:
    return rows.select(doc_id.cast("string").alias("doc_id"), source.alias("source"), place.cast("long").alias("place"), reason.alias("reason"), raw.cast("string").alias("raw"))


def uploads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pictures and pages by ``boxes.read_uploads``; a file whose first bytes, ending or size don't fit is rejected by its verdict."""
    files = boxes.read_uploads(spark, folder).withColumn("doc_id", stem(F.col("path")))
    none = F.lit(None)
    return files.where("verdict = 'ok'"), _rejected(files.where("verdict <> 'ok'"), F.col("doc_id"), F.col("path"), none, F.concat(F.lit("upload: "), "verdict"), none)


def json_records(spark: SparkSession, folder: str, schema: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Lines of JSON objects; a line that isn't one of the schema, or has no key, is rejected with its text and place."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("__source"), F.col("_metadata.file_block_start").alias("__start"))
    parsed = F.from_json("value", f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt"})
    rows = lines.where(F.trim("value") != "").withColumn("r", parsed)
    bad = F.col("r.__corrupt").isNotNull() | F.col("r").isNull()
    why = F.when(bad, "json: not a record").when(F.col(f"r.{key}").isNull(), f"json: no {key}")
    rows = rows.withColumn("why", why)
    good = rows.where("why IS NULL").select("r.*").drop("__corrupt")
    known = F.coalesce(F.get_json_object("value", f"$.{key}"), stem(F.col("__source")))
    return good, _rejected(rows.where("why IS NOT NULL"), known, F.col("__source"), F.col("__start"), F.col("why"), F.col("value"))


def parquet_records(spark: SparkSession, folder: str, schema: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows of Parquet files; a file without its first or last mark, or of which no row could be read, is rejected as a whole, a row without a key by itself.

    Files are told by their first and last bytes. What the reader can't read of a file that has both marks it skips; such a file is
    rejected where it gave no row, and keeps the rows read before the break where it gave some.
    """
    size, content = F.col("length"), F.col("content")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    mark = lambda c: F.hex(c) == "50415231"
    tail = F.hex(F.substring(content, -8, 4))  # the footer's length, its last byte first
    footer = F.conv(F.concat(*(F.substring(tail, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")
    whole = (size >= 12) & mark(F.substring(content, 1, 4)) & mark(F.substring(content, -4, 4)) & (footer + 12 <= size)
    plain = lambda path: F.regexp_replace(path, "^file:/+", "file:/")
    told = settled(files.select(plain(F.col("path")).alias("source"), F.coalesce(whole, F.lit(False)).alias("whole")))
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet").parquet(folder).withColumn("__source", plain(F.col("_metadata.file_path")))
    none = F.lit(None)
    broken = _rejected(told.where("NOT whole"), stem(F.col("source")), F.col("source"), none, F.lit("parquet: truncated or no Parquet"), none)
    read = rows.select(F.col("__source").alias("source")).distinct()
    silent = _rejected(told.where("whole").join(read, "source", "left_anti"), stem(F.col("source")), F.col("source"), none, F.lit("parquet: no row could be read"), none)
    without = _rejected(rows.where(F.col(key).isNull()), stem(F.col("__source")), F.col("__source"), none, F.lit(f"parquet: no {key}"), F.to_json(F.struct(*(c for c in rows.columns if c != "__source"))))
    good = rows.join(told.where("NOT whole").select(F.col("source").alias("__source")), "__source", "left_anti")
    return good.where(F.col(key).isNotNull()).drop("__source"), broken.unionByName(silent).unionByName(without)


def settle(rejected: list[DataFrame], docs: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, dead letters): every document of ``docs`` or of a rejected row has a result, degraded where it has none of its own.

    docs: doc_id, document_type; results: doc_id, document_type, score. A document with a rejected part and a result keeps its result.
    """
    letters = reduce(DataFrame.unionByName, rejected)
    lost = letters.where("doc_id IS NOT NULL").select("doc_id").distinct().join(docs, "doc_id", "left_anti").withColumn("document_type", F.lit("unknown"))
    return assemble.with_degraded(docs.select("doc_id", "document_type").unionByName(lost), results), letters
