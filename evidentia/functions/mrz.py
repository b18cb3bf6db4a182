"""Machine-readable zones as column expressions: formats, fields, check digits, names and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.barrier import once
from evidentia.functions.checkdigits import digit_holds

# Fixed values (ICAO 9303): each field's line (from 1), start and end (from 0, end exclusive), and each check digit's place.
SLICES = {
    "TD3": {
        "document_type": (1, 0, 2), "country": (1, 2, 5), "names": (1, 5, 44), "document_number": (2, 0, 9), "nationality": (2, 10, 13),
        "birth": (2, 13, 19), "sex": (2, 20, 21), "expiry": (2, 21, 27), "optional": (2, 28, 42),
    },
    "TD2": {
        "document_type": (1, 0, 2), "country": (1, 2, 5), "names": (1, 5, 36), "document_number": (2, 0, 9), "nationality": (2, 10, 13),
        "birth": (2, 13, 19), "sex": (2, 20, 21), "expiry": (2, 21, 27), "optional": (2, 28, 35),
    },
    "TD1": {
        "document_type": (1, 0, 2), "country": (1, 2, 5), "document_number": (1, 5, 14), "optional": (1, 15, 30), "birth": (2, 0, 6),
        "sex": (2, 7, 8), "expiry": (2, 8, 14), "nationality": (2, 15, 18), "optional2": (2, 18, 29), "names": (3, 0, 30),
    },
}
CHECKS = {
    "TD3": {"document_number": (2, 9), "birth": (2, 19), "expiry": (2, 27), "optional": (2, 42)},
    "TD2": {"document_number": (2, 9), "birth": (2, 19), "expiry": (2, 27)},
    "TD1": {"document_number": (1, 14), "birth": (2, 6), "expiry": (2, 14)},
}
COMPOSITES = {
    "TD3": ([(2, 0, 10), (2, 13, 20), (2, 21, 43)], (2, 43)),
    "TD2": ([(2, 0, 10), (2, 13, 20), (2, 21, 35)], (2, 35)),
    "TD1": ([(1, 5, 30), (2, 0, 7), (2, 8, 15), (2, 18, 29)], (2, 29)),
}
SHAPES = {"TD3": (2, 44), "TD2": (2, 36), "TD1": (3, 30)}


def _cut(lines: list[Column], at: tuple[int, int, int]) -> Column:
    line, start, end = at
    return F.substring(lines[line - 1], start + 1, end - start)


def recognised(fmt: str, lines: list[Column]) -> Column:
    """Whether the lines have the format's length and hold nothing but 0-9, A-Z and fillers."""
    n, width = SHAPES[fmt]
    ok = F.lit(True)
    for line in lines[:n]:
        ok = ok & F.coalesce(line.rlike(f"^[A-Z0-9<]{{{width}}}$"), F.lit(False))
    return ok


def parse(fmt: str, lines: list[Column]) -> dict[str, Column]:
    """The fields and checks of lines of one format, all null where they aren't recognised."""
    ok = recognised(fmt, lines)
    out = {name: _cut(lines, at) for name, at in SLICES[fmt].items()}
    names = F.regexp_replace(out.pop("names"), "<+$", "")
    at = F.instr(names, "<<")
    plain = lambda c: F.trim(F.replace(c, F.lit("<"), F.lit(" ")))
    out["surname"] = plain(F.when(at > 0, F.substr(names, F.lit(1), at - 1)).otherwise(names))
    out["given_names"] = F.when(at > 0, plain(F.substr(names, at + 2))).otherwise(F.lit(""))
    for name, (line, place) in CHECKS[fmt].items():
        out[f"{name}_ok"] = digit_holds(_cut(lines, SLICES[fmt][name]), _cut(lines, (line, place, place + 1)), SLICES[fmt][name][2] - SLICES[fmt][name][1])
    parts, (line, place) = COMPOSITES[fmt]
    out["composite_ok"] = digit_holds(F.concat(*(_cut(lines, p) for p in parts)), _cut(lines, (line, place, place + 1)), sum(b - a for _, a, b in parts))
    out["check_skipped"] = F.exists(F.array(*(_cut(lines, (a, b, b + 1)) for a, b in [*CHECKS[fmt].values(), (line, place)])), lambda d: d == "<")
    return {"recognised": ok} | {name: F.when(ok, c) for name, c in out.items()}


def kept_lines(lines: Column) -> Column:
    """The lines that aren't null or blank, without trailing blanks."""
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x.isNotNull() & (x != ""))


def layout_of(kept: Column) -> tuple[Column, Column]:
    """(format by the lines' lengths, or null; number of the first line with a character outside the set, or 0) of ``kept_lines``."""
    lengths = F.array_join(F.transform(kept, lambda x: F.length(x).cast("string")), ",")
    fmt = F.lit(None).cast("string")
    for name, (n, width) in SHAPES.items():
        fmt = F.when(lengths == ",".join([str(width)] * n), name).otherwise(fmt)
    return fmt, F.array_position(F.transform(kept, lambda x: x.rlike("^[A-Z0-9<]*$")), False)


def parse_as(fmt: Column, wrong: Column, lines: list[Column]) -> dict[str, Column]:
    """The columns of ``parse_any`` from what ``layout_of`` gives and three kept lines."""
    message = F.when(fmt.isNull(), "unknown line lengths").when(wrong > 0, F.concat(F.lit("characters of line "), wrong.cast("string")))
    parsed = {name: parse(name, lines[: SHAPES[name][0]]) for name in SHAPES}
    names = [n for n in parsed["TD3"] if n != "recognised" and all(n in p for p in parsed.values())]
    merged = {n: F.coalesce(*(F.when(fmt == name, p[n]) for name, p in parsed.items())) for n in names}
    return {"format": fmt, "recognised": fmt.isNotNull() & F.coalesce(wrong == 0, F.lit(False)), "message": message} | merged


def parse_any(lines: Column) -> dict[str, Column]:
    """The format, whether it is recognised, a message (null where it is) and the fields of an array of lines.

    Blank and null lines don't count and trailing blanks are cut; the lengths of what is left decide the format. No
    input raises: unknown lengths have no format, and a character outside the set is told by the number of its line.
    """
    kept = kept_lines(lines)
    return parse_as(*layout_of(kept), [F.get(kept, F.lit(i)) for i in range(3)])


def parse_any_rows(rows: DataFrame, lines: str = "lines") -> DataFrame:
    """``rows`` with the columns of ``parse_any`` in place of their lines; what every field needs is computed once a row."""
    others = [c for c in rows.columns if c != lines]
    rows = once(rows.select(*others, kept_lines(F.col(lines)).alias("__kept")))
    fmt, wrong = layout_of(F.col("__kept"))
    rows = once(rows.select(*others, fmt.alias("__fmt"), wrong.alias("__wrong"), *(F.get("__kept", F.lit(i)).alias(f"__l{i}") for i in range(3))))
    return once(rows.select(*others, *(c.alias(n) for n, c in parse_as(F.col("__fmt"), F.col("__wrong"), [F.col(f"__l{i}") for i in range(3)]).items())))


def century(yy: Column, reference_year: int, past: bool) -> Column:
    """The four-digit year of two digits: for dates in the past never after the reference, else the nearer one, 19YY on a tie."""
    old, new = yy + 1900, yy + 2000
    if past:
        return F.when(yy > reference_year % 100, old).otherwise(new)
    return F.when(F.abs(new - reference_year) < F.abs(old - reference_year), new).otherwise(old)


def iso_date(yymmdd: Column, reference_year: int, past: bool) -> Column:
    """The ISO date of YYMMDD; null unless it is six digits of a day that the calendar has."""
    year = century(F.substring(yymmdd, 1, 2).cast("int"), reference_year, past)
    text = F.concat_ws("-", year.cast("string"), F.substring(yymmdd, 3, 2), F.substring(yymmdd, 5, 2))
    return F.when(yymmdd.rlike("^[0-9]{6}$"), F.date_format(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))
