"""Calendar and clock column expressions (tz-naive; the session runs in UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_HOUR = 3_600_000_000
NTZ = "timestamp_ntz"


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_us(us: Column) -> Column:
    return F.timestamp_micros(us).cast(NTZ)


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast(NTZ)


def hour_ceil(ts: Column) -> Column:
    """Smallest whole hour at or after ``ts``: rows of ``(h-1, h]`` share ``h``."""
    us = epoch_us(ts)
    return from_us(us + F.pmod(-us, F.lit(US_PER_HOUR)))


def add_hours(ts: Column, hours) -> Column:
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    """``seconds`` may be fractional; resolved to the microsecond."""
    return from_us(epoch_us(ts) + F.round(seconds * F.lit(1_000_000.0)).cast("long"))


def seconds_between(start: Column, end: Column) -> Column:
    return (epoch_us(end) - epoch_us(start)) / F.lit(1_000_000.0)


def week_start(day: Column, anchor: str = "MON") -> Column:
    """Start date of the week containing ``day``; ``anchor`` is the week's first weekday."""
    return F.date_sub(F.next_day(day, anchor), 7)


def week_columns(day: str = "date", anchor: str = "MON") -> dict[str, Column]:
    start = week_start(F.col(day), anchor)
    return {"week_start": start, "day_index": F.datediff(F.col(day), start)}


def at_reference_hour(ts: Column, hour: int) -> Column:
    """The survey's calendar day at a fixed clock hour."""
    return add_hours(F.to_date(ts).cast(NTZ), hour)


def strict_timestamp(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with a mandatory 1-6 digit fraction, else NULL."""
    shaped = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$")
    return F.when(shaped, lenient_timestamp(text))


def lenient_timestamp(value: Column) -> Column:
    """Any castable timestamp, else NULL."""
    return value.try_cast(NTZ)


def time_of_day(hour: Column) -> Column:
    return (
        F.when(hour.between(6, 11), "morning")
        .when(hour.between(12, 16), "afternoon")
        .when(hour.between(17, 21), "evening")
        .otherwise("night")
    )


def calendar_features(ts: Column) -> dict[str, Column]:
    """Hour, Monday-based weekday, weekend flags and part of the day."""
    hour, dow = F.hour(ts), F.weekday(ts)
    weekend = dow.isin(5, 6).cast("int")
    return {
        "hour_of_day": hour,
        "day_of_week": dow,
        "is_weekend": weekend,
        "is_weekday": F.lit(1) - weekend,
        "time_of_day": time_of_day(hour),
    }
