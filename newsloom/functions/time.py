"""Dates of the local calendar. Moments are UTC; days are local, at a fixed offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Local time is ahead of UTC by so many minutes (no daylight saving since 2022).
OFFSET_MINUTES = 210
# Month names of the local calendar.
MONTHS = ("فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند")


def minutes(n) -> Column:
    return F.make_dt_interval(mins=n if isinstance(n, Column) else F.lit(n))


def local(moment: Column) -> Column:
    return moment + minutes(OFFSET_MINUTES)


def local_day(moment: Column) -> Column:
    """D05."""
    return F.to_date(local(moment))


def parse_iso(text: Column) -> Column:
    """Null for what is no time; without a zone it is UTC."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def jalali(day: Column) -> Column:
    """The date in the solar calendar, as YYYY-MM-DD.

    By cycles of 33 years (12053 days) of which each fourth year is long, the
    ninth long one a year late; counted from the first day of year 979.
    """
    n = F.datediff(day, F.lit("1600-03-20").cast("date"))
    cycle, left = F.floor(n / 12053), F.pmod(n, F.lit(12053))
    fours, left = F.floor(left / 1461), F.pmod(left, F.lit(1461))
    ones = F.when(left >= 366, F.floor((left - 1) / 365)).otherwise(F.lit(0))
    left = F.when(left >= 366, F.pmod(left - 1, F.lit(365))).otherwise(left)
    month = F.when(left < 186, F.floor(left / 31)).otherwise(F.floor((left - 186) / 30) + 6)
    date = left - F.when(month < 6, month * 31).otherwise(186 + (month - 6) * 30)
    return F.format_string("%04d-%02d-%02d", (979 + 33 * cycle + 4 * fours + ones).cast("int"), (month + 1).cast("int"), (date + 1).cast("int"))


#: The same for DuckDB, of an expression for the date.
def jalali_sql(day: str) -> str:
    n = f"date_diff('day', DATE '1600-03-20', {day})"
    left = f"(({n}) % 12053 % 1461)"
    year = f"(979 + 33 * (({n}) // 12053) + 4 * (({n}) % 12053 // 1461) + CASE WHEN {left} >= 366 THEN ({left} - 1) // 365 ELSE 0 END)"
    rest = f"(CASE WHEN {left} >= 366 THEN ({left} - 1) % 365 ELSE {left} END)"
    month = f"(CASE WHEN {rest} < 186 THEN {rest} // 31 ELSE ({rest} - 186) // 30 + 6 END)"
    date = f"({rest} - CASE WHEN {month} < 6 THEN {month} * 31 ELSE 186 + ({month} - 6) * 30 END)"
    return f"printf('%04d-%02d-%02d', {year}, {month} + 1, {date} + 1)"


def jalali_words(day: Column) -> Column:
    """Day, month's name, year; what is no such date passes through."""
    month = F.try_element_at(F.array(*map(F.lit, MONTHS)), F.nullif(F.substring(day, 6, 2).try_cast("int"), F.lit(0)))
    return F.when(day.rlike("^\\d{4}-\\d{2}-\\d{2}$") & month.isNotNull(), F.concat_ws(" ", F.substring(day, 9, 2).cast("int").cast("string"), month, F.substring(day, 1, 4))).otherwise(day)


def reported_at(published: Column, created: Column, fetched: Column) -> Column:
    """D06."""
    return F.coalesce(published, created, fetched)


def in_quiet_hours(minute: Column, start: Column, end: Column) -> Column:
    """From start to end, over midnight where it wraps; equal bounds never."""
    return F.when(start == end, F.lit(False)).when(start < end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))


def window_days(days: Column) -> Column:
    """D09."""
    return F.greatest(F.lit(1), F.least(days, F.lit(365)))
