"""Timestamps of file systems and cameras as Unix seconds; 0 stands for unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# 100 ns steps between 1601 and 1970, and in a second.
EPOCH_1601, STEPS = 116_444_736_000_000_000, 10_000_000
#: Seconds between 1904 and 1970.
EPOCH_1904 = 2_082_844_800


def filetime_to_unix(x: Column | str) -> Column:
    t = col(x)
    return F.when(t.isNull() | (t <= EPOCH_1601), F.lit(0)).otherwise(F.floor((t - EPOCH_1601) / F.lit(STEPS).cast("decimal(20,0)"))).cast("long")


def hfs_to_unix(x: Column | str) -> Column:
    return F.greatest(F.lit(0), F.coalesce(col(x), F.lit(0)) - EPOCH_1904).cast("long")


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a proleptic Gregorian date; days past a month's end run on into the next month."""
    first = F.make_date(year.cast("int"), month.cast("int"), F.lit(1))
    return F.datediff(first, F.lit("1970-01-01").cast("date")) + day - 1


def dos_to_unix(date: Column | str, time: Column | str) -> Column:
    """A FAT date and time (16 bits each, from 1980, two-second steps); a month or day that can't be is unknown."""
    d, t = col(date).cast("int"), col(time).cast("int")
    field = lambda x, shift, mask: F.shiftright(x, shift).bitwiseAND(mask)
    month, day = field(d, 5, 15), d.bitwiseAND(31)
    valid = month.between(1, 12) & day.between(1, 31)
    days = days_from_civil(field(d, 9, 127) + 1980, F.when(valid, month).otherwise(1), F.when(valid, day).otherwise(1))
    seconds = days.cast("long") * 86400 + field(t, 11, 31) * 3600 + field(t, 5, 63) * 60 + t.bitwiseAND(31) * 2
    return F.when(valid, seconds).otherwise(0).cast("long")


def exif_to_unix(x: Column | str) -> Column:
    """'YYYY:MM:DD hh:mm:ss' in UTC, years 1970 to 2100; else 0."""
    parts = [F.regexp_extract(col(x), r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})", k).try_cast("int") for k in range(1, 7)]
    year, month, day, hour, minute, second = parts
    valid = year.between(1970, 2100) & month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
    days = days_from_civil(F.when(valid, year).otherwise(1970), F.when(valid, month).otherwise(1), F.when(valid, day).otherwise(1))
    unix = days.cast("long") * 86400 + hour * 3600 + minute * 60 + second
    return F.when(valid & (unix > 0), unix).otherwise(0).cast("long")


def timestamp(unix: Column | str) -> Column:
    """Unix seconds as a timestamp; unknown is null."""
    return F.when(col(unix) > 0, F.timestamp_seconds(col(unix)))
