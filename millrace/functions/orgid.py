"""Organisation numbers: nine digits, the last a mod-11 check digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the first eight digits.
WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)


def digits_only(value: Column) -> Column:
    """``value`` without anything but ASCII digits; null stays null."""
    return F.regexp_replace(value, "[^0-9]", "")


def nine_digits(value: Column) -> Column:
    """The nine digits of a number written with spaces, dots or affixes; null unless there are nine."""
    digits = digits_only(value)
    return F.when(F.length(digits) == 9, digits)


def has_valid_check_digit(value: Column) -> Column:
    """Whether the digits of ``value`` are a number with a valid check digit; false for null."""
    digits = digits_only(value)
    total = sum((F.try_element_at(F.split(digits, ""), F.lit(i + 1)).try_cast("int") * w for i, w in enumerate(WEIGHTS)), F.lit(0))
    check = F.when(total % 11 == 0, 0).otherwise(11 - total % 11)
    return F.coalesce((F.length(digits) == 9) & (check != 10) & (check == F.substring(digits, 9, 1).try_cast("int")), F.lit(False))


def numbers_in(text: Column) -> Column:
    """Numbers with a valid check digit in a text, first occurrences: three groups of three digits joined by
    nothing, a space, dot or no-break space, in no longer run of digits and not after a country code."""
    pattern = r"(?<![0-9])(?<!(?:\+|00)[0-9]{1,3}[ \-]{0,3})([0-9]{3}[ . ]?[0-9]{3}[ . ]?[0-9]{3})(?![0-9])"
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), digits_only)
    return F.array_distinct(F.filter(found, has_valid_check_digit))
