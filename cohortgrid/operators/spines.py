"""Complete calendars: days, hours and user panels with explicit gaps.

Ranges come from scalar subqueries and are expanded per row with
``sequence``; nothing is cross-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import filter_users, ntz, study_days
from .skew import chunked_row_number, with_quantile_chunk


def user_days(per_day: DataFrame, value: str, start: str, fill=0) -> DataFrame:
    """Every user with days ``1 .. max day`` of the data, missing days filled, plus the date."""
    last = per_day.agg(F.max("day")).scalar()
    users = per_day.select("app_user_id").distinct()
    spine = users.withColumn("day", F.explode(F.sequence(F.lit(1), last)))
    date = F.date_add(F.lit(start).cast("date"), F.col("day") - 1)
    joined = spine.join(per_day.select("app_user_id", "day", value), ["app_user_id", "day"], "left")
    return joined.select("app_user_id", "day", F.coalesce(F.col(value), F.lit(fill)).alias(value), date.alias("date"))


def daily_totals(df: DataFrame, ts: str, value: str, start: str, end: str) -> DataFrame:
    per_day = study_days(df, ts, start, end).groupBy("app_user_id", "day").agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total")
    )
    return user_days(per_day, "total", start, 0.0)


def counts_per_day(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Records of each user and study day that has any."""
    return study_days(df, ts, start, end).groupBy("app_user_id", "day").agg(F.count(F.lit(1)).alias("count"))


def daily_counts(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    return user_days(counts_per_day(df, ts, start, end), "count", start)


def daily_flags(df: DataFrame, ts: str, start: str, end: str, name: str = "submitted") -> DataFrame:
    """1 on days with at least one submission."""
    per_day = study_days(df, ts, start, end).select("app_user_id", "day").distinct().withColumn(name, F.lit(1))
    return user_days(per_day, name, start)


def hour_profile(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Records and value total for each clock hour, all 24 present."""
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    rows = df.where(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("total_records"), F.sum(value).alias("total_value")
    )
    return hours.join(rows, "hour", "left").na.fill({"total_records": 0, "total_value": 0.0})


def hour_profile_users(df: DataFrame, ts: str, value: str, users: list) -> DataFrame:
    """The hour profile of each listed user, 24 rows per user found in the data or not."""
    rows = filter_users(df, users).where(F.col(ts).isNotNull())
    stats = rows.groupBy("app_user_id", F.hour(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("total_records"), F.sum(value).alias("total_value")
    )
    kind = df.schema["app_user_id"].dataType
    texts = df.sparkSession.createDataFrame([(str(u),) for u in users], "app_user_id string")
    listed = texts.select(F.col("app_user_id").cast(kind))
    spine = listed.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return spine.join(stats, ["app_user_id", "hour"], "left").na.fill({"total_records": 0, "total_value": 0.0})


def completeness(daily: DataFrame, count: str = "count") -> DataFrame:
    """Share of study days with data, per user of a daily spine."""
    return daily.groupBy("app_user_id").agg(
        F.count_if(F.col(count) > 0).alias("days_with_data"),
        (F.count_if(F.col(count) > 0) / F.max("day") * 100).alias("completeness_percentage"),
        F.sum(count).alias("total_records"),
    )


# Completeness histogram edges; the last bin is closed.
COMPLETENESS_EDGES = [0, 25, 50, 75, 90, 100]


def histogram(df: DataFrame, column: str, edges: list[int] | None = None) -> DataFrame:
    """Count per bin ``[lo, hi)``, last bin closed, empty bins included."""
    edges = edges or COMPLETENESS_EDGES
    pairs = list(zip(edges, edges[1:]))
    value = F.col(column)
    label: Column = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(pairs):
        top = value <= hi if i == len(pairs) - 1 else value < hi
        label = F.when((value >= lo) & top, i).otherwise(label)
    counts = df.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("users"))
    bins = df.sparkSession.createDataFrame(
        [(i, lo, hi) for i, (lo, hi) in enumerate(pairs)], "bin int, bin_from int, bin_to int"
    )
    return bins.join(counts, "bin", "left").na.fill(0, ["users"])


def participation(daily: DataFrame, count: str = "count") -> DataFrame:
    """Users with data on each study day."""
    return daily.groupBy("day", "date").agg(
        F.count_distinct(F.when(F.col(count) > 0, F.col("app_user_id"))).alias("participants")
    )


def availability(daily: DataFrame, count: str = "count") -> DataFrame:
    return daily.select("app_user_id", "day", (F.col(count) > 0).cast("int").alias("available"))


STATUS_NAMES = ["none", "data", "survey", "both"]


BITS = 63


def status_matrix(data: DataFrame, surveys: DataFrame, data_col: str, survey_col: str) -> DataFrame:
    """none / data / survey / both for the union of users, on days 1 to the last day of either input.

    Inputs hold ``(app_user_id, day)`` rows, complete spines or only the days that have something. A user's days are
    bits of words of ``BITS`` days, so one aggregation over both inputs holds the whole matrix, and no calendar is
    joined.
    """
    def tagged(df: DataFrame, column: str, place: int) -> DataFrame:
        on = F.coalesce(F.col(column), F.lit(0)) > 0
        return df.select("app_user_id", "day", *[(on if i == place else F.lit(False)).alias(c) for i, c in enumerate("vs")])

    days = tagged(data, data_col, 0).unionByName(tagged(surveys, survey_col, 1))
    word = F.expr(f"(day - 1) div {BITS}")
    mask = F.expr(f"shiftleft(1L, cast((day - 1) % {BITS} as int))")
    words = days.groupBy("app_user_id", word.alias("word")).agg(
        *[F.coalesce(F.bit_or(F.when(F.col(c), mask)), F.lit(0)).cast("long").alias(c) for c in "vs"], F.max("day").alias("last"))
    users = words.groupBy("app_user_id").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("v", "s")))).alias("words"))
    spread = users.withColumn("day", F.explode(F.sequence(F.lit(1), words.agg(F.max("last")).scalar())))
    held = F.col("words")[word]
    on = [F.coalesce(held[c].bitwiseAND(mask) != 0, F.lit(False)).cast("int") for c in "vs"]
    spread = spread.withColumn("state", on[0] + 2 * on[1])
    return spread.select(
        "app_user_id", "day", "state", F.element_at(F.array(*[F.lit(n) for n in STATUS_NAMES]), F.col("state") + 1).alias("status")
    )


def user_totals(daily: DataFrame, value: str) -> DataFrame:
    return daily.groupBy("app_user_id").agg(F.sum(value).alias("total"))


def three_users(totals: DataFrame, value: str = "total") -> DataFrame:
    """The users with the most, the median and the least total.

    The median user is position ``n // 2`` of the ascending order (ties by
    id), found by chunked positions, not by ordering all users in one task.
    """
    chunked = with_quantile_chunk(totals, value)
    placed = chunked_row_number(chunked, [], [F.col(value), F.col("app_user_id")], "rn", "n")
    middle = F.expr("n div 2 + 1")
    roles = F.array_compact(
        F.array(
            F.when(F.col("rn") == F.col("n"), "most"),
            F.when(F.col("rn") == middle, "median"),
            F.when(F.col("rn") == 1, "least"),
        )
    )
    return placed.withColumn("role", F.explode(roles)).select("role", "app_user_id", value)


def date_panel(df: DataFrame, date: str, value: str, users: DataFrame | None = None, fill: float | None = 0.0) -> DataFrame:
    """Users x every date of the data's range; missing cells get ``fill``."""
    sums = df.where(F.col("app_user_id").isNotNull()).groupBy("app_user_id", F.col(date).alias("date")).agg(F.sum(value).alias(value))
    low = df.agg(F.min(date)).scalar()
    high = df.agg(F.max(date)).scalar()
    who = users if users is not None else sums.select("app_user_id").distinct()
    spine = who.select("app_user_id").withColumn("date", F.explode(F.sequence(low, high, F.expr("interval 1 day"))))
    out = spine.join(sums, ["app_user_id", "date"], "left")
    return out if fill is None else out.na.fill(fill, [value])


def update_hourly(df: DataFrame, ts: str, value: str, update: str, days: int = 7) -> DataFrame:
    """Hourly totals within ``days`` of an update date, on a complete hour spine per user."""
    start = ntz(update) - F.make_dt_interval(F.lit(days))
    end = ntz(update) + F.make_dt_interval(F.lit(days + 1))
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    rows = df.withColumn("hour", hour).where((F.col("hour") >= start) & (F.col("hour") < end))
    sums = rows.groupBy("app_user_id", "hour").agg(F.sum(value).alias("hourly_total"))
    spine = sums.select("app_user_id").distinct().withColumn(
        "hour", F.explode(F.sequence(start, end, F.expr("interval 1 hour")))
    )
    return spine.join(sums, ["app_user_id", "hour"], "left")
