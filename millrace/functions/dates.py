"""Dates as native column expressions; the day of reference is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.instants import MONTHS


def date_ladder(value: Column) -> Column:
    """The first reading that gives a date: ISO, RFC 2822, day.month.year, day month-name year; null if none."""
    text = F.trim(value)
    iso = F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1), "yyyy-MM-dd")
    numeric = F.regexp_extract(text, r"^(\d{1,2}\.\d{1,2}\.\d{4})$", 1)
    dotted = F.try_to_date(numeric, "d.M.yyyy")
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    worded = r"(?i)^(?:[a-z]{3}, )?(\d{1,2})\.? ([a-zæøå]+)\.? (\d{4})\b"
    part = lambda k: F.regexp_extract(text, worded, k)
    built = F.concat_ws("-", part(3), F.lpad(F.try_element_at(months, F.lower(part(2))).cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
    named = F.try_to_date(F.when(part(3) != "", built), "yyyy-MM-dd")
    return F.coalesce(iso, dotted, named)


def age_days(at: Column, as_of: Column) -> Column:
    return F.datediff(as_of, at)


def age_band(at: Column, as_of: Column, fresh: int = 45, recent: int = 365, old: int = 730) -> Column:
    """``fresh``, ``recent``, ``aging`` or ``old`` by days before ``as_of``; ``future`` after it, ``unknown`` for null."""
    days = age_days(at, as_of)
    return (
        F.when(days.isNull(), "unknown").when(days < 0, "future").when(days <= fresh, "fresh").when(days <= recent, "recent").when(days <= old, "aging").otherwise("old")
    )


def next_reset(at: Column, daily: Column) -> Column:
    """When a quota resets: the next day, or the first day of the next month."""
    return F.when(daily, F.date_add(at.cast("date"), 1)).otherwise(F.add_months(F.trunc(at, "MM"), 1))
