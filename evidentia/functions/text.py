"""Names, genders and number shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a sex or gender.
GENDERS = {"M": "MALE", "MALE": "MALE", "MAIL": "MALE", "F": "FEMALE", "FEMALE": "FEMALE", "FMALE": "FEMALE", "T": "TRANSGENDER", "TRANS": "TRANSGENDER", "TRANSGENDER": "TRANSGENDER", "O": "OTHER", "OTHER": "OTHER"}

# Loose shapes of document numbers by type.
NUMBER_SHAPES = {
    "aadhaar": "^[0-9]{12}$",
    "pan_card": "^[A-Z]{5}[0-9]{4}[A-Z]$",
    "passport": "^[A-Z]{1,3}[A-Z0-9]{5,8}$",
    "voter_id": "^([A-Z]{3}[0-9]{7}|[A-Z0-9]{10})$",
    "driving_license": "^[A-Z]{2}[0-9]{2}[0-9]{7,11}$",
    "id_card": "^[A-Z0-9]{4,20}$",
    "national_id": "^[A-Z0-9]{4,20}$",
    "residence_permit": "^[A-Z0-9]{4,20}$",
}


def gender(value: Column) -> Column:
    pairs = [F.lit(x) for pair in GENDERS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(value)))


def name_words(value: Column) -> Column:
    """The words of a name in upper case, sorted, so that order doesn't count."""
    return F.array_sort(F.array_remove(F.split(F.regexp_replace(F.upper(value), "[^A-Z]+", " "), " "), ""))


def cleaned_number(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit("<"), F.lit(""))


def number_fits(document_type: Column, value: Column) -> Column:
    """Whether a number has its type's shape; null for a type without one."""
    out = F.lit(None).cast("boolean")
    for name, shape in NUMBER_SHAPES.items():
        out = F.when(document_type == name, cleaned_number(value).rlike(shape)).otherwise(out)
    return out


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


# What a date and a sex look like inside a longer reading.
DATE_TOKEN = r"\d{1,4}[/.-]\d{1,2}[/.-]\d{2,4}"
SEX_TOKEN = r"(?i)(male|female|M|F)"


def alphanumeric(value: Column) -> Column:
    """In upper case, without anything but A-Z and 0-9."""
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def date_token(value: Column) -> Column:
    """The first date in a text, or the text without white space."""
    found = F.regexp_extract(value, DATE_TOKEN, 0)
    return F.when(found != "", found).otherwise(F.regexp_replace(value, r"\s+", ""))


def sex_token(value: Column) -> Column:
    """The first sex in a text, in upper case, or the trimmed text."""
    found = F.upper(F.regexp_extract(value, SEX_TOKEN, 1))
    return F.when(found != "", found).otherwise(F.trim(value))


def percent(share: Column) -> Column:
    """A share as whole percent, half to even."""
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))
