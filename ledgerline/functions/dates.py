"""Partial dates, ages, calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partial_date(text: Column) -> Column:
    """struct(value, precision) of year, year-month or year-month-day in common spellings; UNKNOWN if none, or outside 1900 to 2100."""
    clean = F.regexp_replace(F.regexp_replace(text, "[年月/.]", "-"), "日", "")
    clean = F.regexp_replace(F.trim(clean), "-+$", "")
    part = lambda k: F.regexp_extract(clean, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", k)
    y, m, d = part(1), part(2), part(3)
    text_of = F.format_string("%s-%s-%s", y, F.when(m == "", "1").otherwise(m), F.when(d == "", "1").otherwise(d))
    value = F.when((y >= "1900") & (y <= "2100"), F.try_to_timestamp(text_of, F.lit("yyyy-M-d")).cast("date"))
    precision = F.when(value.isNull(), "UNKNOWN").when(d != "", "DAY").when(m != "", "MONTH").otherwise("YEAR")
    return F.struct(value.alias("value"), precision.alias("precision"))


def interval_of(value: Column, precision: Column) -> Column:
    """struct(first, last) of the days that a partial date may mean; nulls if unknown."""
    first = F.when(precision == "YEAR", F.trunc(value, "year")).when(precision == "MONTH", F.trunc(value, "month")).when(precision == "DAY", value)
    last = F.when(precision == "YEAR", F.make_date(F.year(value), F.lit(12), F.lit(31))).when(precision == "MONTH", F.last_day(value)).when(precision == "DAY", value)
    return F.struct(first.alias("first"), last.alias("last"))


def selection_state(value: Column, precision: Column, start: Column, end: Column) -> Column:
    """included, excluded, or uncertain where only a part of the interval is inside (or the date is unknown)."""
    days = interval_of(value, precision)
    return F.when(days["first"].isNull(), "uncertain").when((days["first"] >= start) & (days["last"] <= end), "included").when((days["last"] < start) | (days["first"] > end), "excluded").otherwise("uncertain")


def completed_years(birth: Column, day: Column) -> Column:
    """Years completed on a day, by month and day."""
    early = (F.month(day) < F.month(birth)) | ((F.month(day) == F.month(birth)) & (F.dayofmonth(day) < F.dayofmonth(birth)))
    return F.year(day) - F.year(birth) - early.cast("int")


def compatible_times(a: Column, b: Column) -> Column:
    """Whether two clocks agree to the minute."""
    return F.date_trunc("minute", a) == F.date_trunc("minute", b)


def date_label(value: Column, precision: Column) -> Column:
    return F.when(precision == "YEAR", F.date_format(value, "yyyy")).when(precision == "MONTH", F.date_format(value, "yyyy-MM")).when(precision == "DAY", F.date_format(value, "yyyy-MM-dd")).otherwise("unknown")


def month_of(at: Column) -> Column:
    """The first day of a date's month."""
    return F.trunc(at.cast("date"), "month")


def canonical_utc(local: Column, zone: str) -> Column:
    """A local time without a zone as an ISO time in UTC, whatever the session's zone."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local.cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
