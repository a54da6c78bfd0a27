"""Clocks of the different logs, brought to epoch milliseconds (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zone_ms(stamp: Column, zone: str) -> Column:
    return F.unix_millis(F.to_utc_timestamp(stamp, zone))


def minute_of_year_ms(moy: Column, ms: Column, year: int, zone: str, simulation: bool = False) -> Column:
    """Minute of the year and millisecond of the minute; simulation time counts from the epoch."""
    if simulation:
        start = F.lit(0)
    else:
        start = _zone_ms(F.make_timestamp(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), zone)
    return (moy.cast("long") * 60_000 + ms + start).cast("long")


def date_struct_ms(d: Column, zone: str = "UTC") -> Column:
    """Year, month, day, hour, minute and millisecond-of-minute fields (`second` holds ms)."""
    day = F.make_timestamp(d["year"], d["month"], d["day"], d["hour"], d["minute"], F.lit(0))
    return _zone_ms(day, zone) + d["second"].cast("long")


def gps_ms(date: Column, seconds_in_day: Column) -> Column:
    """DDMMYY date and seconds in the day."""
    return F.unix_millis(F.to_timestamp(date, "ddMMyy")) + F.round(seconds_in_day * 1000).cast("long")


def time_of_day_ms(text: Column) -> Column:
    """HH:MM:SS with , or . before the fraction, as milliseconds of the day."""
    part = F.split(F.regexp_replace(text, ",", "."), ":")
    return (part[0].cast("long") * 3_600_000 + part[1].cast("long") * 60_000
            + F.round(part[2].cast("double") * 1000).cast("long"))


def shift_ms(stamp: Column, offset: Column) -> Column:
    """Time since an offset rounded to ms, null when negative."""
    moved = F.round(stamp - offset).cast("long")
    return F.when(moved >= 0, moved)
