"""What comes in from readers: pooled sides of a document, decoded barcodes by channel, cleaned fields, readings' confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import payloads, text

#: Sides in the order in which their lines are pooled.
SIDES = ("front", "back")
# Formats that can hold a licence, and each channel's parts and the fields they are.
CODE_FORMATS = ("QRCODE", "DATAMATRIX", "PDF417")
CHANNEL_FIELDS = {
    "aadhaar_qr": {"uid": "document_number", "name": "surname", "gender": "sex", "dob": "date_of_birth"},
    "dl_barcode": {"document_number": "document_number", "surname": "surname", "date_of_birth": "date_of_birth", "date_of_expiry": "date_of_expiry"},
}
CODE_CONFIDENCE = 0.99
# A document's confidence in percent by its best evidence, and the mean's stand-in.
EVIDENCE = {"barcode": 99.0, "mrz": 98.0, "other": 88.0}
NO_CONFIDENCE = 0.85


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's path), line_no (from 0), text: hand-fed lines, a text file a document; an empty file has no line."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.regexp_replace("value", "\r?\n$", "").alias("value"))
    return files.where("value <> ''").select("doc_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "text"))


def pool_sides(front: DataFrame, back: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0 over both sides), side, text: the front's lines, then the back's.

    A document with one side only has that side's lines. Equal line numbers of a side are taken in order of their text.
    """
    sides = [rows.select("doc_id", F.lit(k).alias("k"), F.lit(side).alias("side"), "line_no", "text") for k, (side, rows) in enumerate(zip(SIDES, (front, back), strict=True))]
    order = Window.partitionBy("doc_id").orderBy("k", "line_no", "text")
    return reduce(DataFrame.unionByName, sides).select("doc_id", (F.row_number().over(order) - 1).alias("line_no"), "side", "text")


def barcode_channels(decodes: DataFrame) -> DataFrame:
    """Decodes (doc_id, seq, format, text, raw) once for each format and text, with channel, first_of_channel and parts.

    A repeated decode keeps its least seq. A QR code whose payload decodes is aadhaar_qr; a code of any format of
    ``CODE_FORMATS`` whose text has a licence number is dl_barcode; the rest is unclassified. parts maps the
    channel's names to values that aren't empty, with signature_present of a signed QR payload, and is null where
    unclassified. A null text counts as empty.
    """
    rows = decodes.select("doc_id", "seq", "format", F.coalesce("text", F.lit("")).alias("text"), "raw")
    rows = rows.groupBy("doc_id", "format", "text").agg(F.min_by("raw", "seq").alias("raw"), F.min("seq").alias("seq"))
    found = payloads.decode_identity(rows.withColumn("payload", F.coalesce("raw", F.col("text").cast("binary"))), "payload")
    licence = payloads.decode_licence(F.col("text"))
    held = {
        "aadhaar_qr": {name: F.col(name) for name in CHANNEL_FIELDS["aadhaar_qr"]} | {"signature_present": F.when(F.col("signature_present"), "true")},
        "dl_barcode": {"document_number": licence["number"], "surname": licence["name"], "date_of_birth": licence["birth"], "date_of_expiry": licence["expiry"]},
    }
    channel = F.when((F.col("format") == "QRCODE") & F.col("decoded"), "aadhaar_qr").when(F.col("format").isin(*CODE_FORMATS) & licence["number"].isNotNull(), "dl_barcode").otherwise("unclassified")
    maps = {c: F.map_filter(F.create_map(*(x for n, v in parts.items() for x in (F.lit(n), v))), lambda k, v: F.coalesce(v, F.lit("")) != "") for c, parts in held.items()}
    parts = F.when(F.col("channel") == "aadhaar_qr", maps["aadhaar_qr"]).when(F.col("channel") == "dl_barcode", maps["dl_barcode"])
    out = found.withColumn("channel", channel).withColumn("parts", parts)
    first = F.row_number().over(Window.partitionBy("doc_id", "channel").orderBy("seq", "format", "text")) == 1
    return out.select("doc_id", "seq", "format", "text", "channel", first.alias("first_of_channel"), "parts")


def barcode_parts(channels: DataFrame) -> DataFrame:
    """doc_id, seq, channel, name, value: a row for each part of each classified code, and one without a part for any other."""
    return channels.select("doc_id", "seq", "channel", F.explode_outer("parts").alias("name", "value"))


def barcode_fields(parts: DataFrame) -> DataFrame:
    """doc_id, name, value, confidence of ``barcode_parts``: fields under their own names; of several decodes the first with a value wins."""
    named = F.create_map(*(F.lit(x) for channel, names in CHANNEL_FIELDS.items() for part, field in names.items() for x in (f"{channel}/{part}", field)))
    rows = parts.where(F.trim("value") != "").withColumn("field", F.try_element_at(named, F.concat_ws("/", "channel", "name"))).where("field IS NOT NULL")
    best = rows.groupBy("doc_id", F.col("field").alias("name")).agg(F.min(F.struct("seq", "value")).alias("b"))
    return best.select("doc_id", "name", F.col("b.value").alias("value"), F.lit(CODE_CONFIDENCE).alias("confidence"))


def clean_fields(fields: DataFrame) -> DataFrame:
    """fields (name, value, ...) with the value cleaned by what its name asks for; other names keep theirs."""
    name, value = F.col("name"), F.col("value")
    dated = name.isin("date_of_birth", "date_of_expiry", "issue_date")
    cleaned = F.when(name == "document_number", text.alphanumeric(value)).when(dated, text.date_token(value)).when(name == "sex", text.sex_token(value)).otherwise(value)
    return fields.withColumn("value", cleaned)


def passport_numbers(lines: DataFrame) -> DataFrame:
    """doc_id, passport_number: the first capital and seven digits in a document's lines, joined by blanks in upper case; null for none."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    return lines.groupBy("doc_id").agg(joined.alias("t")).select("doc_id", F.nullif(F.regexp_extract(F.upper("t"), "[A-Z][0-9]{7}", 0), F.lit("")).alias("passport_number"))


def reading_confidence(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, ocr_confidence in percent: the mean of the fields' positive confidences, or a constant by the evidence there is.

    documents: doc_id, has_barcode, has_mrz. A document whose fields have no positive confidence gets ``NO_CONFIDENCE``.
    """
    mean = fields.groupBy("doc_id").agg(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("mean"), F.count(F.lit(1)).alias("n"))
    rows = documents.join(mean, "doc_id", "left")
    percent = F.round(F.round(F.coalesce("mean", F.lit(NO_CONFIDENCE)) * 100, 6), 1)
    chosen = F.when(F.col("n") > 0, percent).when(F.col("has_barcode"), EVIDENCE["barcode"]).when(F.col("has_mrz"), EVIDENCE["mrz"]).otherwise(EVIDENCE["other"])
    return rows.select("doc_id", chosen.alias("ocr_confidence"))


def weighted_angles(segments: DataFrame, least: float = 20.0) -> DataFrame:
    """image_id, angle: the length-weighted mean angle in degrees, folded into -45 to 45, of segments of ``least`` or longer.

    segments: image_id, x1, y1, x2, y2; an image without such a segment has angle 0.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length, raw = F.sqrt(dx * dx + dy * dy), F.degrees(F.atan2(dy, dx))
    rows = segments.select("image_id", length.alias("w"), F.when(raw > 45, raw - 90).when(raw < -45, raw + 90).otherwise(raw).alias("a"))
    kept = F.col("w") >= least
    total = F.sum(F.when(kept, F.col("a") * F.col("w"))) / F.sum(F.when(kept, F.col("w")))
    return rows.groupBy("image_id").agg(F.coalesce(total, F.lit(0.0)).alias("angle"))


def byte_bias(data: Column) -> Column:
    """The sum of the first 64 bytes, modulo 100, over 100: the reference rule looks at no more."""
    head = F.hex(F.substring(data, 1, 64))
    numbers = F.transform(F.sequence(F.lit(1), F.length(head), F.lit(2)), lambda i: F.conv(F.substr(head, i, F.lit(2)), 16, 10).cast("int"))
    total = F.aggregate(F.when(F.length(head) > 0, numbers).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, x: s + x)
    return total % 100 / 100


def hash_pick(data: Column) -> Column:
    """The SHA-256 modulo 3: a hexadecimal number and the sum of its digits leave the same remainder."""
    digits = F.split(F.sha2(data.cast("binary"), 256), "")
    return F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int")), F.lit(0), lambda s, x: s + x) % 3
