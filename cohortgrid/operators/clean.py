"""Row filters, deduplication and session repair."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecols import add_seconds, seconds_between

ALL_USERS = -1
APP_NAME_EXCLUSION = r"(?i)launcher|controller"
FIRST_SESSION_CUTOFF = "2026-02-26 00:00:00"


def ntz(text) -> Column:
    return F.lit(str(text)).cast("timestamp_ntz")


def filter_user(df: DataFrame, app_user_id: int = ALL_USERS) -> DataFrame:
    if app_user_id == ALL_USERS:
        return df
    if "app_user_id" not in df.columns:
        raise KeyError("app_user_id column not found; cannot filter by user")
    return df.where(F.col("app_user_id") == app_user_id)


def filter_users(df: DataFrame, users: list, column: str = "app_user_id") -> DataFrame:
    return df.where(F.col(column).isin(list(users)))


def filter_dates(df: DataFrame, date_range, column: str) -> DataFrame:
    """Both ends inclusive, on the raw timestamp (an end date means its midnight)."""
    if date_range is None:
        return df
    if len(date_range) != 2:
        raise ValueError("date_range must be (start, end)")
    start, end = date_range
    return df.where(F.col(column).between(ntz(start), ntz(end)))


def study_days(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows of ``[start, end)`` with a 1-based ``day`` number."""
    inside = df.where((F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end)))
    day = F.datediff(F.to_date(F.col(ts)), F.lit(start).cast("date")) + 1
    return inside.withColumn("day", day).where(F.col("day") >= 1)


def filter_hour_band(df: DataFrame, ts: str, first: int, last: int) -> DataFrame:
    return df.where(F.hour(ts).between(first, last))


def drop_excluded_apps(df: DataFrame, column: str = "app_name", pattern: str = APP_NAME_EXCLUSION) -> DataFrame:
    """NULL names stay."""
    return df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def users_seen_since(df: DataFrame, cutoff: str, column: str = "date") -> DataFrame:
    """All rows of users with a row at or after ``cutoff``."""
    recent = df.where(F.col(column) >= F.lit(cutoff).cast(df.schema[column].dataType))
    return df.join(recent.select("app_user_id").distinct(), "app_user_id", "left_semi")


def keep_first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key.

    Spark limits each group on the map side before the shuffle
    (WindowGroupLimit), so a large group of copies never travels whole.
    """
    rn = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n)
    return out if rank else out.drop(rn)


def dedup_start(df: DataFrame, start: str = "start_timestamp", id_col: str = "id", keys: list[str] | None = None) -> DataFrame:
    """One row per start timestamp and user, smallest id first.

    ``keys=[start]`` deduplicates across users.
    """
    if keys is None:
        keys = [k for k in ("app_user_id", start) if k in df.columns]
    return keep_first(df, keys, [F.col(id_col)])


def drop_repeated_sessions(df: DataFrame) -> DataFrame:
    """Exact repeats collected under several parent sessions: keep the earliest."""
    keys = ["app_user_id", "start_time", "end_time", "app_name", "total_time_ms", "last_time_used"]
    return keep_first(df, keys, [F.col("screentime_id"), F.col("line")])


def latest_cumulative(df: DataFrame) -> DataFrame:
    """Counters are cumulative per (session, app): keep the last reading."""
    order = [F.col("last_time_used").desc_nulls_last(), F.col("line").desc(), F.col("total_time_ms").desc()]
    order += [F.col("app_category")] if "app_category" in df.columns else []
    return keep_first(df, ["screentime_id", "app_name"], order)


def repair_gaps(sessions: DataFrame, max_gap_seconds: int = 120) -> DataFrame:
    """Start a session at the user's previous end when it follows within the gap.

    Overlaps count as following. The previous row is looked up inside each
    (user, hour); the first row of an hour takes the last end of the user's
    previous active hour, so neither a user nor a busy day is ordered in one
    task. Rows without a user follow no other and are set aside.
    """
    rows = sessions.where(F.col("app_user_id").isNotNull()).withColumn("_hour", F.date_trunc("hour", "start_time"))
    order = F.struct("start_time", "id")
    last = rows.groupBy("app_user_id", "_hour").agg(F.max(F.struct(order.alias("o"), F.col("end_time").alias("e"))).alias("_last"))
    by_user = Window.partitionBy("app_user_id").orderBy("_hour")
    carried = last.select("app_user_id", "_hour", F.lag(F.col("_last.e")).over(by_user).alias("_carried"))
    in_hour = Window.partitionBy("app_user_id", "_hour").orderBy("start_time", "id")
    out = rows.join(carried, ["app_user_id", "_hour"], "left")
    out = out.withColumn("_first", F.row_number().over(in_hour) == 1)
    out = out.withColumn("previous_end", F.when(F.col("_first"), F.col("_carried")).otherwise(F.lag("end_time").over(in_hour)))
    close = seconds_between(F.col("previous_end"), F.col("start_time")) <= max_gap_seconds
    repaired = F.when(close, F.col("previous_end")).otherwise(F.col("start_time"))
    out = out.withColumn("start_time", repaired).select(*sessions.columns, "previous_end")
    alone = sessions.where(F.col("app_user_id").isNull())
    return out.unionByName(alone.withColumn("previous_end", F.lit(None).cast(sessions.schema["end_time"].dataType)))


def repair_first_session(sessions: DataFrame, cutoff: str = FIRST_SESSION_CUTOFF) -> DataFrame:
    """Shift a user's first session when it starts before its parent session.

    Such a row recorded its start as its end: it becomes
    ``[last_used, last_used + total]``. Rows at or after ``cutoff`` are left.
    """
    key = F.struct("calculated_start_time", "screentime_id", "line", "app_name", "total_time_ms")
    firsts = sessions.where(F.col("app_user_id").isNotNull()).groupBy("app_user_id").agg(F.min(key).alias("_first"))
    out = sessions.join(firsts, "app_user_id", "left")
    wrong = (
        (key == F.col("_first"))
        & (F.col("calculated_start_time") < F.col("start_time"))
        & (F.col("last_time_used") < ntz(cutoff))
    )
    wrong = F.coalesce(wrong, F.lit(False))
    moved = add_seconds(F.col("last_time_used"), F.col("total_time_seconds"))
    return out.withColumns(
        {
            "calculated_start_time": F.when(wrong, F.col("last_time_used")).otherwise(F.col("calculated_start_time")),
            "last_time_used": F.when(wrong, moved).otherwise(F.col("last_time_used")),
        }
    ).drop("_first")


def join_parent(apps: DataFrame, parents: DataFrame) -> DataFrame:
    """Child sessions with their parent's user and times (left join)."""
    parent = parents.select(F.col("id").alias("screentime_id"), "app_user_id", "start_time", "end_time")
    return apps.join(parent, "screentime_id", "left")


def repaired_sessions(apps: DataFrame, parents: DataFrame, cutoff: str = FIRST_SESSION_CUTOFF, days: DataFrame | None = None,
                      reach: int = 0) -> DataFrame:
    """App sessions under their parents without repeats, with derived start times and ``was_first``: the user's first
    session, shifted as in ``repair_first_session``.

    Each user's first session is found from one row for each parent, and only its parent carries it back to the
    sessions, so these are shuffled to their parents and to their repeats, and not once more to their users. Repeats
    share the start, and the earliest one stays, so a first session is the same before they go.

    With ``days`` (``app_user_id, days``: an array of dates, one row for each user), only sessions that start on one of
    their user's days, or at most ``reach`` days before it, are sure to be among the rows; most others leave before
    repeats are looked for. The test takes both starts a session can have, so repeats pass or leave together.
    """
    apps = drop_excluded_apps(apps)
    # One shuffle for both readers: they differ in no column or filter below it.
    placed = apps.where(F.col("screentime_id").isNotNull()).repartition("screentime_id")
    seconds = F.col("total_time_ms") / F.lit(1000.0)
    start = add_seconds(F.col("last_time_used"), -seconds).alias("start")
    key = F.struct(start, F.struct("line", "app_name", "total_time_ms").alias("own"))
    least = placed.groupBy("screentime_id").agg(F.min(key).alias("_least"))
    parent = parents.select(F.col("id").alias("screentime_id"), "app_user_id", "start_time", "end_time")
    if days is not None:
        parent = parent.join(days.select("app_user_id", F.col("days").alias("_days")), "app_user_id")
    firsts = parent.where(F.col("app_user_id").isNotNull()).join(least, "screentime_id").groupBy("app_user_id").agg(
        F.min(F.struct("_least.start", "screentime_id", "_least.own")).alias("_first"))
    firsts = firsts.select("app_user_id", "_first.screentime_id", F.struct("_first.start", "_first.own").alias("_first"))
    joined = placed.join(parent.join(firsts, ["screentime_id", "app_user_id"], "left"), "screentime_id", "left")
    if days is not None:
        on = lambda ts, i: F.array_contains("_days", F.date_add(F.to_date(ts), i))
        joined = joined.where(reduce(or_, [on(ts, i) for ts in (start, F.col("last_time_used")) for i in range(reach + 1)])).drop("_days")
    alone = apps.where(F.col("screentime_id").isNull())
    wrong = (key == F.col("_first")) & (start < F.col("start_time")) & (F.col("last_time_used") < ntz(cutoff))
    marked = joined.withColumn("was_first", F.coalesce(wrong, F.lit(False))).drop("_first")
    marked = marked.unionByName(alone.select(*[F.col(c) if c in alone.columns else F.lit(False if c == "was_first" else None).cast(
        marked.schema[c].dataType).alias(c) for c in marked.columns]))
    last, moved = F.col("last_time_used"), add_seconds(F.col("last_time_used"), seconds)
    return drop_repeated_sessions(marked).withColumns(
        {
            "total_time_seconds": seconds,
            "calculated_start_time": F.when(F.col("was_first"), last).otherwise(add_seconds(last, -seconds)),
            "last_time_used": F.when(F.col("was_first"), moved).otherwise(last),
        }
    )


def app_sessions(apps: DataFrame, parents: DataFrame, cutoff: str = FIRST_SESSION_CUTOFF, days: DataFrame | None = None,
                 reach: int = 0) -> DataFrame:
    """App usage sessions with derived start times; ``days`` and ``reach`` as in ``repaired_sessions``."""
    return repaired_sessions(apps, parents, cutoff, days, reach).select(
        "app_user_id", "app_name", "calculated_start_time", "last_time_used", "total_time_ms", "total_time_seconds"
    )


def categorized_sessions(apps: DataFrame, parents: DataFrame) -> DataFrame:
    """Categorised app sessions: latest counters, user and minutes."""
    joined = drop_excluded_apps(latest_cumulative(join_parent(apps, parents)))
    return joined.withColumn("total_time_minutes", F.col("total_time_ms") / F.lit(60000.0))
