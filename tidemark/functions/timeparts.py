"""Times and dates in Beijing, independent of the session's time zone."""

from __future__ import annotations

from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def utc_time(epoch_seconds: Column) -> Column:
    """Instant of epoch seconds as a UTC wall clock without a zone."""
    return F.timestamp_add("SECOND", epoch_seconds, _epoch())


def epoch_seconds(utc: Column) -> Column:
    """Whole seconds since the epoch of a UTC wall clock, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", _epoch(), utc) / 1_000_000).cast("long")


def beijing_time(utc: Column) -> Column:
    """Beijing's wall clock at a UTC wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc)


def beijing_date(epoch: Column) -> Column:
    return beijing_time(utc_time(epoch)).cast("date")


def iso_weekday(day: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(day) + 1


def midnight_epoch(day: Column) -> Column:
    """Epoch seconds at which a date begins in Beijing."""
    return epoch_seconds(F.convert_timezone(F.lit(ZONE), F.lit("UTC"), day.cast("timestamp_ntz")))


def midnight(day: date) -> int:
    """The same for a date known beforehand: bounds that reach the scan as plain numbers."""
    return int(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(ZONE)).timestamp())


def split_of(day: Column, train: tuple[date, date], val: date, test: date) -> Column:
    """``train`` for a range of dates, ends included, ``val``, ``test`` or ``out_of_range``."""
    return (
        F.when(day.between(F.lit(train[0]), F.lit(train[1])), "train")
        .when(day == F.lit(val), "val")
        .when(day == F.lit(test), "test")
        .otherwise("out_of_range")
    )


def text_in_two_zones(epoch: Column) -> Column:
    """Epoch seconds as text: UTC and Beijing's wall clock."""
    utc = utc_time(epoch)
    form = "yyyy-MM-dd HH:mm:ss"
    return F.concat(F.date_format(utc, form), F.lit(" UTC / "), F.date_format(beijing_time(utc), form), F.lit(" Beijing"))
