"""Date and week arithmetic.

Two week conventions are in use: reporting weeks cut on Sundays, financial weeks on Mondays. Everything here takes the
reference date as an argument, so a report can be re-run for any day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_A_SUNDAY = dt.date(1970, 1, 4)


def sunday_week_index(day: Column) -> Column:
    """Number of the Sunday-started week a date lies in (week 0 starts on 1970-01-04)."""
    return F.floor(F.datediff(day, F.lit(_A_SUNDAY)) / 7)


def sunday_weeks_between(end: Column, start: Column) -> Column:
    """How many Sundays lie in ``(start, end]``: a week difference that counts boundaries, not 7-day spans."""
    return (sunday_week_index(end) - sunday_week_index(start)).cast("int")


def sunday_week_start(day: Column) -> Column:
    """The Sunday on or before a date."""
    return F.date_sub(F.next_day(day, "SUN"), 7)


def monday_week_start(day: Column) -> Column:
    """The Monday on or before a date."""
    return F.to_date(F.trunc(day, "week"))


def is_monday(day: Column) -> Column:
    return F.dayofweek(day) == 2


def reporting_week_end(day: Column) -> Column:
    """Week-end date to report on: last Sunday when run on a Monday, else the coming Sunday."""
    this_sunday = sunday_week_start(day)
    return F.when(is_monday(day), this_sunday).otherwise(F.date_add(this_sunday, 7))


def add_weeks(day: Column, weeks: Column | int) -> Column:
    """Shift a date by whole weeks; ``weeks`` may be negative or a column."""
    weeks = weeks if isinstance(weeks, Column) else F.lit(weeks)
    return F.date_add(day, (weeks * 7).cast("int"))


def local_timestamp(instant: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` of a UTC instant."""
    return F.from_utc_timestamp(instant.cast("timestamp"), zone)


def local_date(instant: Column, zone: str) -> Column:
    """Calendar date in ``zone`` of a UTC instant."""
    return F.to_date(local_timestamp(instant, zone))


def per_month(amount: Column, first: Column, last: Column) -> Column:
    """Amount per 30-day month between two dates; NULL for a span of zero days."""
    return F.try_divide(amount.cast("double"), F.datediff(last, first) / 30)


def ascending_range(first: Column, last: Column) -> Column:
    """Integers ``first..last`` as an array, empty when ``first > last`` (a bare ``sequence`` would count down)."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
