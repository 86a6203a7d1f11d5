"""Time-grid aggregation: hourly, daily and weekly tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import value_column
from ..functions.timecols import hour_floor, week_columns, week_start
from .clean import ALL_USERS, dedup_start, filter_dates, filter_user
from .fill import fill_gaps
from .skew import exact_medians


def _sum0(c: Column) -> Column:
    """Sum in which a bucket of only-missing values totals 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


AGGREGATES = {
    "sum": _sum0,
    "mean": F.avg,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "median": F.median,  # of groups that fit in a buffer; ``bucket_metric`` selects medians of any size
}

# Metric -> (aggregate, daily column, hourly column).
HEALTH_METRICS = {
    "steps": ("sum", "daily_steps", "hourly_steps"),
    "distance": ("sum", "daily_distance", "hourly_distance"),
    "calories": ("sum", "daily_calories", "hourly_calories"),
    "speed": ("mean", "daily_avg_speed", "hourly_avg_speed"),
}


def aggregate(name: str) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; use one of {sorted(AGGREGATES)}")
    return AGGREGATES[name]


def time_key(unit: str, ts: str) -> Column:
    if unit == "H":
        return hour_floor(F.col(ts))
    if unit == "D":
        return F.to_date(ts)
    raise ValueError(f"unsupported time unit {unit!r}; use 'D' or 'H'")


def bucket_metric(df: DataFrame, agg: str | list[str], unit: str, start: str = "start_timestamp", value: str | None = None,
                  app_user_id: int = ALL_USERS, date_range=None, dedup_keys: list[str] | None = None) -> DataFrame:
    """One metric per (user, time bucket): ``app_user_id, time_key, value``.

    A list of aggregates gives ``value_<name>`` columns from one pass; a median takes two more (``exact_medians``),
    so that no bucket's values are held in one buffer.
    """
    value = value or value_column(df)
    rows = dedup_start(df, start, keys=dedup_keys)
    rows = filter_dates(filter_user(rows, app_user_id), date_range, start)
    rows = rows.where(F.col(start).isNotNull())
    keys = ["time_key"]
    if "app_user_id" in df.columns:
        rows, keys = rows.where(F.col("app_user_id").isNotNull()), ["app_user_id", "time_key"]
    named = {"value": agg} if isinstance(agg, str) else {f"value_{a}": a for a in agg}
    rows = rows.withColumn("time_key", time_key(unit, start))
    medians = [name for name, a in named.items() if a == "median"]
    plain = [aggregate(a)(F.col(value)).alias(name) for name, a in named.items() if a != "median"]
    out = rows.groupBy(*keys).agg(*plain) if plain else rows.select(*keys).distinct()
    for name in medians:
        middle = exact_medians(rows.select(*keys, value), keys, [value]).withColumnRenamed(value, name)
        out = out.join(middle, keys, "left")
    return out.select(*keys, *named)


def tag_metrics(tables: dict[str, DataFrame], start: str = "start_timestamp") -> DataFrame:
    """Per-metric tables as one long table ``id, app_user_id, metric, value, start``."""
    parts = [
        df.select("id", "app_user_id", F.lit(metric).alias("metric"),
                  F.col(value_column(df)).cast("double").alias("value"), F.col(start).alias("start_timestamp"))
        for metric, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def metric_grid(events: DataFrame, unit: str, app_user_id: int = ALL_USERS, date_range=None,
                dedup_keys: list[str] | None = None, metrics: dict | None = None) -> DataFrame:
    """All metrics side by side per (user, bucket).

    Same rows as a full outer join of the per-metric tables, from one
    conditional aggregation over the tagged events.
    """
    metrics = metrics or HEALTH_METRICS
    pos = 1 if unit == "D" else 2
    keys = ["metric", *(dedup_keys or ["app_user_id", "start_timestamp"])]
    rows = dedup_start(events.where(F.col("metric").isin(list(metrics))), keys=keys)
    rows = filter_dates(filter_user(rows, app_user_id), date_range, "start_timestamp")
    rows = rows.where(F.col("app_user_id").isNotNull() & F.col("start_timestamp").isNotNull())
    aggs = []
    for metric, spec in metrics.items():
        mine = F.col("metric") == metric
        value = aggregate(spec[0])(F.when(mine, F.col("value")))
        if spec[0] == "sum":
            value = F.when(F.count_if(mine) > 0, value)
        aggs.append(value.alias(spec[pos]))
    return rows.withColumn("time_key", time_key(unit, "start_timestamp")).groupBy("app_user_id", "time_key").agg(*aggs)


def daily_health(events: DataFrame, week_anchor: str = "MON", app_user_id: int = ALL_USERS, date_range=None,
                 fill: str | None = None, dedup_keys: list[str] | None = None) -> DataFrame:
    grid = metric_grid(events, "D", app_user_id, date_range, dedup_keys).withColumnRenamed("time_key", "date")
    grid = grid.withColumns(week_columns("date", week_anchor))
    values = [spec[1] for spec in HEALTH_METRICS.values()]
    grid = fill_gaps(grid, values, fill, ["app_user_id"], "date")
    return grid.select("app_user_id", "date", "week_start", "day_index", *values)


def with_hour_columns(grid: DataFrame, week_anchor: str = "MON") -> DataFrame:
    """Date, week and the ordinal of each active hour within its (user, day)."""
    grid = grid.withColumn("date", F.to_date("datetime")).withColumns(week_columns("date", week_anchor))
    in_day = Window.partitionBy("app_user_id", "date").orderBy("datetime")
    return grid.withColumn("hour_index", F.row_number().over(in_day) - 1)


def hourly_health(events: DataFrame, week_anchor: str = "MON", app_user_id: int = ALL_USERS, date_range=None,
                  fill: str | None = None, dedup_keys: list[str] | None = None) -> DataFrame:
    grid = metric_grid(events, "H", app_user_id, date_range, dedup_keys).withColumnRenamed("time_key", "datetime")
    values = [spec[2] for spec in HEALTH_METRICS.values()]
    grid = fill_gaps(with_hour_columns(grid, week_anchor), values, fill, ["app_user_id"], "datetime")
    return grid.select("app_user_id", "datetime", "date", "week_start", "day_index", "hour_index", *values)


def weekly_average(df: DataFrame, name: str = "avg_daily_steps", start: str = "start_timestamp",
                   value: str | None = None, week_anchor: str = "MON", app_user_id: int = ALL_USERS,
                   date_range=None, dedup_keys: list[str] | None = None, agg: str = "sum") -> DataFrame:
    """Weekly mean of daily totals.

    Days without data between a user's first and last day count as 0, and
    every week in between has a row. The divisor is the number of calendar
    days of the week inside that range, so days are never materialised.
    """
    value = value or value_column(df, weekly=True)
    daily = bucket_metric(df, agg, "D", start, value, app_user_id, date_range, dedup_keys)
    return _weekly_means(daily, ["app_user_id"], week_anchor).select("app_user_id", "week_start", F.col("mean").alias(name))


def _weekly_means(daily: DataFrame, keys: list[str], week_anchor: str) -> DataFrame:
    """Mean per (keys, week) of daily totals ``time_key, value`` over the key's own day range."""
    daily = daily.withColumn("week_start", week_start(F.col("time_key"), week_anchor))
    # Weekly totals keep the day range, so one aggregation feeds both uses.
    weekly = daily.groupBy(*keys, "week_start").agg(
        F.sum("value").alias("total"), F.min("time_key").alias("first"), F.max("time_key").alias("last")
    )
    span = weekly.groupBy(*keys).agg(
        F.min("first").alias("first_day"), F.max("last").alias("last_day"),
        F.min("week_start").alias("w0"), F.max("week_start").alias("w1"),
    )
    weeks = span.select(
        *keys, "first_day", "last_day",
        F.explode(F.sequence("w0", "w1", F.expr("interval 7 days"))).alias("week_start"),
    )
    days = (
        F.datediff(F.least(F.col("last_day"), F.date_add("week_start", 6)),
                   F.greatest(F.col("first_day"), F.col("week_start"))) + 1
    )
    joined = weeks.join(weekly.select(*keys, "week_start", "total"), [*keys, "week_start"], "left")
    return joined.select(*keys, "week_start", (F.coalesce("total", F.lit(0.0)) / days).alias("mean"))


# Metric -> weekly column.
WEEKLY_METRICS = {
    "steps": "avg_daily_steps", "calories": "avg_daily_calories", "speed": "avg_daily_speed", "distance": "avg_daily_distance",
}


def weekly_health(events: DataFrame, week_anchor: str = "MON", metrics: dict[str, str] | None = None) -> DataFrame:
    """Weekly means of all metrics for user-weeks that have every one of them.

    Same rows as inner joins of the per-metric weekly tables, from one pass
    over the tagged events. ``metrics={"steps": ...}`` is the steps-only form.
    """
    metrics = metrics or WEEKLY_METRICS
    rows = dedup_start(events.where(F.col("metric").isin(list(metrics))), keys=["metric", "app_user_id", "start_timestamp"])
    rows = rows.where(F.col("app_user_id").isNotNull() & F.col("start_timestamp").isNotNull())
    keys = ["app_user_id", "metric"]
    daily = rows.groupBy(*keys, F.to_date("start_timestamp").alias("time_key")).agg(_sum0(F.col("value")).alias("value"))
    means = _weekly_means(daily, keys, week_anchor)
    wide = means.groupBy("app_user_id", "week_start").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(name) for m, name in metrics.items()]
    )
    return wide.dropna(subset=list(metrics.values()))


def hourly_screentime(sessions: DataFrame, week_anchor: str = "MON", app_user_id: int = ALL_USERS, date_range=None,
                      fill: str | None = None) -> DataFrame:
    """Session seconds per (user, hour of derived start)."""
    rows = filter_dates(filter_user(sessions, app_user_id), date_range, "calculated_start_time")
    rows = rows.where(F.col("app_user_id").isNotNull() & F.col("calculated_start_time").isNotNull())
    grid = rows.groupBy("app_user_id", hour_floor(F.col("calculated_start_time")).alias("datetime")).agg(
        _sum0(F.col("total_time_seconds")).alias("hourly_screentime")
    )
    grid = fill_gaps(with_hour_columns(grid, week_anchor), ["hourly_screentime"], fill, ["app_user_id"], "datetime")
    return grid.select("app_user_id", "datetime", "date", "week_start", "day_index", "hour_index", "hourly_screentime")


def daily_screentime(sessions: DataFrame, start: str = "calculated_start_time", seconds: str = "total_time_seconds",
                     week_anchor: str = "MON", app_user_id: int = ALL_USERS, date_range=None,
                     fill: str | None = None) -> DataFrame:
    """Session seconds per (user, date), from app or parent sessions."""
    rows = filter_dates(filter_user(sessions, app_user_id), date_range, start)
    rows = rows.where(F.col("app_user_id").isNotNull() & F.col(start).isNotNull())
    grid = rows.groupBy("app_user_id", F.to_date(start).alias("date")).agg(_sum0(F.col(seconds)).alias("daily_screentime"))
    grid = fill_gaps(grid.withColumns(week_columns("date", week_anchor)), ["daily_screentime"], fill, ["app_user_id"], "date")
    return grid.select("app_user_id", "date", "week_start", "day_index", "daily_screentime")


def day_hour_pivot(hourly: DataFrame, value: str, fill: str | None = "zero", ordinal: bool = False) -> DataFrame:
    """One row per (user, date) with ``hour_0 .. hour_23``.

    ``ordinal`` numbers a day's active hours instead of using the clock hour.
    """
    slot = F.col("hour_index") if ordinal else F.hour("datetime")
    wide = hourly.withColumn("_slot", slot).groupBy("app_user_id", "date")
    cols = [F.expr(f"sum(CASE WHEN _slot = {h} THEN {value} END) AS hour_{h}") for h in range(24)]
    out = wide.agg(*cols)
    return out.na.fill(0.0, [f"hour_{h}" for h in range(24)]) if fill == "zero" else out
