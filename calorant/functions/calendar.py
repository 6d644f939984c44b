"""Local days and half hours; instants are timestamps without zone that hold UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/London"


def local_time(utc: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def utc_time(local: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def day_bounds(day: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """First instant of a local day and of the next, in UTC."""
    return utc_time(day.cast("timestamp_ntz"), zone), utc_time(F.date_add(day, 1).cast("timestamp_ntz"), zone)


def half_hours(day: Column, zone: str = ZONE) -> Column:
    """The starts of a local day's half hours in UTC: 46, 48 or 50."""
    begin, end = day_bounds(day, zone)
    return F.filter(F.sequence(begin, end, F.expr("interval 30 minutes")), lambda t: t < end)


def offset_minutes(utc: Column, zone: str = ZONE) -> Column:
    return F.timestamp_diff("MINUTE", utc, local_time(utc, zone)).cast("int")


def date_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).cast("int")
