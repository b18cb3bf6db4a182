"""Check digits as column expressions: 7-3-1 of machine-readable zones, Verhoeff, and a weighted sum modulo 36."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Verhoeff scheme's base permutation.
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def verhoeff_product(a: int, b: int) -> int:
    """Multiplication in the dihedral group of order 10."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def verhoeff_power(position: int, digit: int) -> int:
    for _ in range(position % 8):
        digit = VERHOEFF_PERMUTATION[digit]
    return digit


PRODUCTS = [verhoeff_product(a, b) for a in range(10) for b in range(10)]
POWERS = [verhoeff_power(i, d) for i in range(8) for d in range(10)]
INVERSES = [next(b for b in range(10) if verhoeff_product(a, b) == 0) for a in range(10)]

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<"
#: What each character of the alphabet adds, modulo 10, as a digit: letters are 10 to 35, the filler is 0.
_UNITS = "".join(str(i % 10) for i in range(36)) + "0"
#: The sum of three digits weighted by 7, 3 and 1, modulo 10, by the number that they make.
_TRIPLES = [(7 * (n // 100) + 3 * (n // 10 % 10) + n % 10) % 10 for n in range(1000)]
#: Characters of the longest text that a check digit is taken of: more than any composite of a zone has.
LONGEST, LONGEST_NUMBER = 54, 24


def _table(values: list[int]) -> Column:
    """A constant array; one text is far quicker to hand over than its numbers, and is taken apart when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _with(value: Column, of) -> Column:
    """``of(value)``, the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def char_value(ch: Column) -> Column:
    """0-9 as they are, A-Z as 10 to 35, the filler as 0; null for anything else."""
    return F.when(ch == "<", 0).when(ch.between("0", "9"), F.ascii(ch) - 48).when(ch.between("A", "Z"), F.ascii(ch) - 55)


def mrz_check_digit(text: Column, longest: int = LONGEST) -> Column:
    """The 7-3-1 digit of a text of 0-9, A-Z and fillers; null if it holds anything else or is longer than ``longest``.

    Characters become digits at once, and three digits are one look-up: a fixed sum, without a loop over characters.
    """
    groups = -(-longest // 3)
    units = F.rpad(F.translate(text, _ALPHABET, _UNITS), 3 * groups, "0")
    total = _with(units, lambda u: sum((F.get(_table(_TRIPLES), F.substring(u, 3 * k + 1, 3).try_cast("int")) for k in range(groups)), F.lit(0)))
    return F.when((F.translate(text, _ALPHABET, "") == "") & (F.length(text) <= longest), total % 10)


def digit_holds(data: Column, digit: Column, longest: int = LONGEST) -> Column:
    """Whether a check digit fits; a filler in its place always does, another character never."""
    fits = mrz_check_digit(data, longest).cast("string") == digit
    return F.when(digit == "<", True).when(digit.between("0", "9"), F.coalesce(fits, F.lit(False))).otherwise(False)


def _verhoeff(digits: Column, shift: int) -> Column:
    """The product of a number's digits from its end on, each by its place's power; null for other texts and longer ones.

    One look-up a place: by the product so far and the place's digit, or 10 before the number begins.
    """
    steps = [[PRODUCTS[c * 10 + POWERS[(i + shift) % 8 * 10 + d]] if d < 10 else c for c in range(10) for d in range(11)] for i in range(8)]

    def product(padded):
        total = F.lit(0)
        for i in range(LONGEST_NUMBER):
            total = F.get(_table(steps[i % 8]), total * 11 + F.ascii(F.substring(padded, LONGEST_NUMBER - i, 1)) - 48)
        return total

    padded = F.lpad(digits, LONGEST_NUMBER, ":")  # ":" follows "9"
    return F.when((F.translate(digits, "0123456789", "") == "") & F.length(digits).between(1, LONGEST_NUMBER), _with(padded, product))


def verhoeff_valid(digits: Column) -> Column:
    """Whether a text of up to ``LONGEST_NUMBER`` digits ends in its Verhoeff digit; false for any other text, null for null."""
    return F.when(digits.isNotNull(), F.coalesce(_verhoeff(digits, 0) == 0, F.lit(False)))


def verhoeff_check_digit(digits: Column) -> Column:
    return F.get(_table(INVERSES), _verhoeff(digits, 1)).cast("string")


#: Values by code from "0" on; -1 for characters without one.
_VALUES = [int(chr(c), 36) if chr(c).isalnum() else 0 if chr(c) == "<" else -1 for c in range(48, 91)]


def mod36_check_char(text: Column) -> Column:
    """The character of the sum of the first nine values, weighted by their places, modulo 36; null where one has no value."""
    first, total = F.rpad(F.substring(text, 1, 9), 9, "0"), F.lit(0)
    for i in range(9):
        value = F.get(_table(_VALUES), F.ascii(F.substring(first, i + 1, 1)) - 48)
        total = total + F.when(value >= 0, value) * (i + 1)
    return F.when(total % 36 < 10, (total % 36).cast("string")).otherwise(F.char(total % 36 + 55))
