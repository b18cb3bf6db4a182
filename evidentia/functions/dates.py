"""Date layouts and date arithmetic as column expressions. The reference date is always a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layouts each reader accepts, in order; the first that fits wins.
VISUAL = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy")
LOGICAL = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "M/d/yyyy")
FIELDS = ("yyyy-M-d", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy")


def _shape(layout: str) -> str:
    return "^" + layout.replace(".", r"\.").replace("yyyy", "[0-9]{4}").replace("M", "[0-9]{1,2}").replace("d", "[0-9]{1,2}") + "$"


def parse(text: Column, layouts: tuple[str, ...] = VISUAL) -> Column:
    """The date of a text in the first layout that fits; null for none. Layouts are tried on whole trimmed texts only."""
    value = F.trim(text)
    tries = []
    for layout in layouts:
        date = F.try_to_timestamp(F.when(value.rlike(_shape(layout)), value), F.lit(layout)).cast("date")
        tries.append(date)
    return reduce(lambda a, b: F.coalesce(a, b), tries)


def age(birth: Column, reference: Column) -> Column:
    """Whole years at the reference date."""
    later = F.date_format(reference, "MMdd") < F.date_format(birth, "MMdd")
    return F.year(reference) - F.year(birth) - later.cast("int")
