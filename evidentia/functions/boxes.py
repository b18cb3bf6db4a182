"""Boxes, file names, uploads and the frontal-face proxy as column expressions; image decoding stays outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD = 10 << 20
# Accepted file endings, and what such files begin with, in hexadecimal.
ENDINGS = r"(?i).*\.(jpg|jpeg|png|pdf)$"
MAGIC = {"FFD8FF": "image/jpeg", "89504E47": "image/png", "25504446": "application/pdf"}


def css_box(top: Column, right: Column, bottom: Column, left: Column, height: Column, width: Column) -> Column:
    """top, right, bottom, left trimmed to the image."""
    zero = F.lit(0)
    return F.struct(F.greatest(top, zero).alias("top"), F.least(right, width).alias("right"), F.least(bottom, height).alias("bottom"), F.greatest(left, zero).alias("left"))


def fractional_box(xs: Column, ys: Column, width: Column, height: Column) -> Column:
    """The least and largest corner coordinates as shares of the image's size, within 0 to 1."""
    share = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size))
    return F.struct(share(F.array_min(xs), width).alias("x0"), share(F.array_min(ys), height).alias("y0"), share(F.array_max(xs), width).alias("x1"), share(F.array_max(ys), height).alias("y1"))


def crop_name(stem: Column) -> Column:
    """A file stem with anything but word characters and hyphens replaced, at most 24 characters."""
    return F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9_\-]", "_"), 1, 24)


def frontal_confidence(depths: Column) -> Column:
    """1 - deviation / 0.14 of landmark depths, within 0.40 to 0.99, three decimals."""
    n = F.size(depths)
    mean = F.aggregate(depths, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(depths, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    return F.round(F.greatest(F.lit(0.40), F.least(F.lit(0.99), 1 - spread / 0.14)), 3)


def upload_gate(files: DataFrame) -> DataFrame:
    """files: path, length, head (first bytes), with media_type and verdict: ok, empty, too_large or unsupported."""
    head = F.hex("head")
    media = F.lit(None).cast("string")
    for magic, name in MAGIC.items():
        media = F.when(head.startswith(magic), name).otherwise(media)
    verdict = F.when(F.col("length") == 0, "empty").when(F.col("length") > MAX_UPLOAD, "too_large").when(media.isNull() | ~F.col("path").rlike(ENDINGS), "unsupported").otherwise("ok")
    return files.withColumns({"media_type": media, "verdict": verdict})


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime and the gate's columns of a folder's files, newest first. Spark's reader lists no file of length 0."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime", F.substring("content", 1, 8).alias("head"))
    return upload_gate(files).drop("head").orderBy(F.desc("modificationTime"), "path")


def upload_named(files: DataFrame, name: str) -> DataFrame:
    """The files whose last path element is ``name``; a name with a slash in it finds none."""
    return files.where(F.element_at(F.split("path", "/"), -1) == name)
