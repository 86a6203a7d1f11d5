"""Survey-answer coercions: integers, yes/no, clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# 12-hour and 24-hour clock parts.
H12, H24, MIN, AMPM = r"(1[0-2]|0[1-9]|[1-9])", r"(2[0-3]|[0-1]\d|\d)", r"([0-5]\d|\d)", r"(am|pm)"

# These two run on dozens of columns at once, so each is one SQL expression
# rather than a tree of Column calls.
SAFE_INT = (
    "CASE WHEN {c} RLIKE r'" + NUMBER.replace("{", "{{").replace("}", "}}") + "' "
    "THEN coalesce(try_cast({c} AS bigint), try_cast(try_cast({c} AS double) AS bigint)) END"
)
STRIPPED = r"regexp_replace({c}, r'^\s+|\s+$', '')"
YES_NO = (
    f"CASE WHEN lower({STRIPPED}) IN ('1', 'yes', 'y', 'true', 't') THEN 1 "
    f"WHEN lower({STRIPPED}) IN ('0', 'no', 'n', 'false', 'f') THEN 0 END"
)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def safe_int(column: str) -> Column:
    """Whole number from text, truncating decimals; anything else is NULL."""
    return F.expr(SAFE_INT.format(c=column))


def yes_no(column: str) -> Column:
    """1 or 0 from a yes/no spelling, else NULL."""
    return F.expr(YES_NO.format(c=column))


def majority_yes(mean: Column) -> Column:
    """0/1 from an averaged yes/no item; half counts as yes."""
    return F.when(mean.isNotNull(), (mean >= 0.5).cast("int"))


def clock_seconds(text: Column) -> Column:
    """Seconds since midnight of a typed clock time, or NULL.

    Accepts 12-hour times with or without minutes, colon, space or dots in
    the marker (``11:23 pm``, ``1123pm``, ``11 p.m.``) and 24-hour times.
    """
    plain = stripped(text)
    dotless = F.lower(F.replace(plain, F.lit("."), F.lit("")))

    def group(source: Column, pattern: str, i: int) -> Column:
        return F.regexp_extract(source, pattern, i).cast("int")

    def half_day(pattern: str, marker: int) -> Column:
        hour = F.pmod(group(dotless, pattern, 1), F.lit(12))
        return hour + F.when(F.regexp_extract(dotless, pattern, marker) == "pm", 12).otherwise(0)

    colon12 = rf"^{H12}:{MIN}\s*{AMPM}$"
    colon24 = rf"^{H24}:{MIN}(?::{MIN})?$"
    hour12 = rf"^{H12}\s*{AMPM}$"
    run12 = rf"^{H12}{MIN}\s*{AMPM}$"
    seconds = F.regexp_extract(plain, colon24, 3)
    return (
        F.when(dotless.rlike(colon12), half_day(colon12, 3) * 3600 + group(dotless, colon12, 2) * 60)
        .when(
            plain.rlike(colon24),
            group(plain, colon24, 1) * 3600
            + group(plain, colon24, 2) * 60
            + F.when(seconds == "", 0).otherwise(seconds.cast("int")),
        )
        .when(dotless.rlike(hour12), half_day(hour12, 2) * 3600)
        .when(dotless.rlike(run12), half_day(run12, 3) * 3600 + group(dotless, run12, 2) * 60)
    )


def sleep_hours(asleep: Column, awake: Column) -> Column:
    """Hours from falling asleep to waking, crossing midnight when needed."""
    gap = clock_seconds(awake) - clock_seconds(asleep)
    return F.round(F.when(gap <= 0, gap + 86_400).otherwise(gap) / 3600.0, 3)
