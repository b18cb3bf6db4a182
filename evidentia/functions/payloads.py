"""Barcode payloads. Inflating is the one step without a built-in, so it is an Arrow-batched pandas UDF."""

from __future__ import annotations

import base64
import binascii
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The attributes of an identity payload.
ATTRIBUTES = ["uid", "name", "gender", "yob", "dob", "phone", "email", "co", "house", "street", "lm", "loc", "vtc", "subdist", "dist", "state", "pc"]
#: Inflated payloads above this size are taken as garbage.
MAX_BYTES = 1 << 16


def _text(raw: bytes | None) -> str | None:
    for form in (raw, _base64(raw)) if raw else ():
        if form is None:
            continue
        if form.lstrip()[:1] == b"<":
            return form.decode("utf-8", "replace")
        try:
            out = zlib.decompressobj().decompress(form, MAX_BYTES + 1)
        except zlib.error:
            continue
        if len(out) > MAX_BYTES:
            return None
        if out.lstrip()[:1] == b"<":
            return out.decode("utf-8", "replace")
    return None


def _base64(raw: bytes) -> bytes | None:
    try:
        return base64.b64decode(raw, validate=True)
    except (binascii.Error, ValueError):
        return None


@F.pandas_udf(StringType())
def payload_text(raw: pd.Series) -> pd.Series:
    """The markup of a plain, deflated, or base64 deflated payload; null for anything else."""
    return raw.map(_text)


def json_vector(text: Column) -> Column:
    """A JSON array of numbers; null for anything else."""
    return F.from_json(F.when(F.trim(text).startswith("["), text), "array<double>")


def json_factors(text: Column) -> Column:
    """A JSON object of numbers as a map; null for anything else."""
    return F.from_json(F.when(F.trim(text).startswith("{"), text), "map<string,double>")


def attribute(markup: Column, name: str) -> Column:
    found = F.regexp_extract(markup, rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1)
    child = F.regexp_extract(markup, rf"<{name}>([^<]*)</{name}>", 1)
    return F.nullif(F.when(found != "", found).otherwise(child), F.lit(""))


def decode_identity(payloads: DataFrame, raw: str = "raw") -> DataFrame:
    """``payloads`` without raw, with the attributes there are, signature_present and decoded (a uid, name or birth date)."""
    rows = payloads.withColumn("__markup", payload_text(F.col(raw)))
    out = rows.select(*(c for c in payloads.columns if c != raw), *(attribute(F.col("__markup"), a).alias(a) for a in ATTRIBUTES), F.coalesce(F.lower("__markup").contains("signature"), F.lit(False)).alias("signature_present"))
    return out.withColumn("decoded", F.coalesce("uid", "name", "dob").isNotNull())


# Accepted names of a licence payload's parts, in lower case without blanks, hyphens and underscores; any name
# that contains one of ``LICENCE_WORDS`` is the number's too. What a number and a date look like in it.
LICENCE_KEYS = {"number": ["licenceno", "licenseno", "dlno"], "name": ["name", "holdername"], "birth": ["dob", "dateofbirth", "birthdate"], "expiry": ["validtill", "expirydate", "validuntil"]}
LICENCE_WORDS = ["licence", "license"]
LICENCE_NUMBER = r"[A-Z]{2}\s*\d{2}\s*\d{4}\s*\d{7,11}"
LICENCE_DATE = r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"


def decode_licence(payload: Column) -> dict[str, Column]:
    """number, name, birth and expiry of a licence barcode's text, in upper case.

    A JSON object is read by its keys, of several keys of one part the last whose value fits; then the first number and the
    first date anywhere in the text fill number and birth. A number under its key that has no licence's shape stays as it is.
    """
    text = F.upper(F.regexp_replace(F.regexp_replace(payload, r"[^\p{Print}\p{L}\s]", ""), r"\s+", " "))
    entries = F.map_entries(F.from_json(F.when(F.trim(text).startswith("{"), text), "map<string,string>"))
    entries = F.transform(entries, lambda e: F.struct(F.lower(F.regexp_replace(e["key"], "[ _-]", "")).alias("key"), F.trim(e["value"]).alias("value")))
    found = lambda pattern, x: F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))
    number = lambda v: F.coalesce(F.replace(found(LICENCE_NUMBER, v), F.lit(" "), F.lit("")), v)
    named = lambda part, k: k.isin(*LICENCE_KEYS[part]) if part != "number" else k.isin(*LICENCE_KEYS[part]) | k.rlike("|".join(LICENCE_WORDS))
    read = {"number": number, "name": lambda v: v, "birth": lambda v: found(LICENCE_DATE, v), "expiry": lambda v: found(LICENCE_DATE, v)}

    def keyed(part):
        mine = F.filter(entries, lambda e: named(part, e["key"]) & (e["value"] != ""))
        values = F.transform(mine, lambda e: read[part](e["value"]))
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))

    anywhere = {"number": F.regexp_replace(found(LICENCE_NUMBER, text), r"\s", ""), "birth": found(LICENCE_DATE, text)}
    return {part: F.coalesce(keyed(part), anywhere[part]) if part in anywhere else keyed(part) for part in read}
