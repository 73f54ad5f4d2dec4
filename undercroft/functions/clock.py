"""Time columns. Journal stamps are wall-clock values held in a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def boundary_diff(unit: str, a: str | Column, b: str | Column) -> Column:
    """How many unit boundaries lie between two stamps (not full units)."""
    size = SECONDS[unit]
    return (F.floor(F.unix_seconds(col(b)) / size) - F.floor(F.unix_seconds(col(a)) / size)).cast("long")


def shift(ts: str | Column, seconds: int) -> Column:
    """Stamp plus a whole number of seconds."""
    return F.timestamp_micros(F.unix_micros(col(ts)) + F.lit(int(seconds) * 1_000_000))


def day_start(day: str | Column) -> Column:
    return col(day).cast("timestamp")


def local_ts(utc: str | Column, hours: int = 3) -> Column:
    """Wall clock of the network: a fixed offset, no summer time."""
    return shift(utc, hours * 3600)


def local_day(utc: str | Column, hours: int = 3) -> Column:
    return F.to_date(local_ts(utc, hours))


def local_midnight(utc: str | Column, hours: int = 3) -> Column:
    """The last local midnight not later than a moment, as a UTC stamp."""
    return shift(F.date_trunc("day", local_ts(utc, hours)), -hours * 3600)


def night(ts: str | Column) -> Column:
    h = F.hour(col(ts))
    return (h >= 22) | (h < 6)


def off_hours(ts: str | Column, day_off: str | Column) -> Column:
    """Night, or any hour of a day off."""
    return (col(day_off) == 1) | night(ts)


def work_hours(ts: str | Column, day_off: str | Column, lo: int = 8, hi: int = 16) -> Column:
    h = F.hour(col(ts))
    return (col(day_off) == 0) & (h >= lo) & (h < hi)


def whole_weeks_shift(now: str | Column, start: str | Column) -> Column:
    """Days of the largest whole-week shift that keeps ``start`` not later than ``now``."""
    week = 7 * 86400
    return (F.floor((F.unix_seconds(col(now)) - F.unix_seconds(col(start))) / week) * 7).cast("int")


def shift_days(ts: str | Column, days: str | Column) -> Column:
    return F.timestamp_micros(F.unix_micros(col(ts)) + col(days).cast("long") * F.lit(86_400_000_000))
