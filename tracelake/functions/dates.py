"""Calendar expressions of periodic reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import _col


def month_start(d: Column | str) -> Column:
    return F.trunc(_col(d), "month")


def month_end(d: Column | str) -> Column:
    return F.last_day(_col(d))


def previous_month_start(d: Column | str) -> Column:
    return F.add_months(F.trunc(_col(d), "month"), -1)


def previous_month_end(d: Column | str) -> Column:
    return F.last_day(previous_month_start(d))


def previous_business_day(d: Column | str) -> Column:
    """The latest weekday before a date."""
    day = F.weekday(_col(d))  # Monday is 0
    return F.date_sub(_col(d), F.when(day == 0, 3).when(day == 6, 2).otherwise(1))


def is_weekly_day(d: Column | str) -> Column:
    """Fridays."""
    return F.weekday(_col(d)) == 4


def is_monthly_day(d: Column | str) -> Column:
    """Mondays: the month before has always ended then."""
    return F.weekday(_col(d)) == 0


def week_start(d: Column | str) -> Column:
    return F.trunc(_col(d), "week")


def folder_timestamp(name: Column | str) -> Column:
    """The timestamp yyyyMMdd_HHmmss in a folder's name; null where there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(_col(name), r"(\d{8}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))
