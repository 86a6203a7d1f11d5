"""Category usage reports and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import filter_hour_band, keep_first

# Weekday names, Monday first.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def hours() -> Column:
    return F.sum("total_time_ms") / F.lit(3_600_000.0)


def category_stats(sessions: DataFrame) -> DataFrame:
    """Hours, records, users and apps per category with shares of the rounded total."""
    base = sessions.where(F.col("app_category").isNotNull()).groupBy("app_category").agg(
        F.round(hours(), 2).alias("total_hours"),
        F.count(F.lit(1)).alias("record_count"),
        F.count_distinct("app_user_id").alias("unique_users"),
        F.count_distinct("app_name").alias("unique_apps"),
    )
    # One row per category: the empty window partition holds the category list only.
    everything = F.sum("total_hours").over(Window.partitionBy())
    return base.withColumns(
        {
            "pct_of_total": F.round(F.col("total_hours") / everything * 100, 2),
            "avg_hours_per_user": F.round(F.col("total_hours") / F.col("unique_users"), 2),
        }
    )


def top_categories(sessions: DataFrame, n: int) -> DataFrame:
    return (
        sessions.where(F.col("app_category").isNotNull())
        .groupBy("app_category").agg(hours().alias("hours"))
        .orderBy(F.col("hours").desc(), "app_category").limit(n)
    )


def top_with_other(sessions: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest categories by hours and the remainder as ``Other``."""
    totals = sessions.where(F.col("app_category").isNotNull()).groupBy("app_category").agg(hours().alias("hours"))
    place = F.row_number().over(Window.orderBy(F.col("hours").desc(), "app_category"))
    named = totals.withColumn("category", F.when(place <= n, F.col("app_category")).otherwise("Other"))
    return named.groupBy("category").agg(F.sum("hours").alias("hours"))


def largest(sums: DataFrame, n: int) -> DataFrame:
    """The ``n`` categories with most time, from sums ``app_category, .., ms``: a ranking of a small table."""
    totals = sums.where(F.col("app_category").isNotNull()).groupBy("app_category").agg((F.sum("ms") / 3_600_000.0).alias("hours"))
    return totals.orderBy(F.col("hours").desc(), "app_category").limit(n)


def category_by_hour(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Hours per (category, clock hour) for the top categories, wide, missing 0. One pass over the sessions."""
    hour = F.hour("last_time_used")
    ms = [F.coalesce(F.sum(F.when(hour == h, F.col("total_time_ms"))) / 3_600_000.0, F.lit(0.0)).alias(f"h{h}") for h in range(24)]
    wide = sessions.where(F.col("app_category").isNotNull()).groupBy("app_category").agg(hours().alias("_hours"), *ms)
    return wide.orderBy(F.col("_hours").desc(), "app_category").limit(n).drop("_hours")


def category_by_weekday(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Hours per (weekday, category) for the top categories, Monday first, missing 0."""
    sums = sessions.groupBy("app_category", F.weekday("last_time_used").alias("weekday")).agg(F.sum("total_time_ms").alias("ms"))
    top = largest(sums, n)
    sums = sums.select("app_category", "weekday", (F.col("ms") / 3_600_000.0).alias("hours"))
    spine = top.select("app_category").withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    names = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday") + 1)
    joined = spine.join(sums, ["app_category", "weekday"], "left").na.fill(0.0, ["hours"])
    return joined.select("weekday", names.alias("day_name"), "app_category", "hours")


def user_categories(sessions: DataFrame) -> DataFrame:
    """Hours per (user, category); NULL users drop out."""
    rows = sessions.where(F.col("app_user_id").isNotNull() & F.col("app_category").isNotNull())
    return rows.groupBy("app_user_id", "app_category").agg(hours().alias("hours"))


def user_behavior(sessions: DataFrame) -> DataFrame:
    """Categories, hours and share of the top category per user."""
    per_user = user_categories(sessions).groupBy("app_user_id").agg(
        F.count(F.lit(1)).alias("category_count"), F.sum("hours").alias("total_hours"), F.max("hours").alias("top_hours")
    )
    share = F.when(F.col("total_hours") > 0, F.col("top_hours") / F.col("total_hours") * 100).otherwise(0.0)
    return per_user.select("app_user_id", "category_count", "total_hours", share.alias("top_category_pct"))


def diversity_summary(sessions: DataFrame) -> DataFrame:
    """Spread of category counts over users and their correlation with hours.

    The median runs over category counts, whose distinct values are bounded
    by the number of categories.
    """
    return user_behavior(sessions).agg(
        F.count(F.lit(1)).alias("users"),
        F.avg("category_count").alias("mean_categories"),
        F.median("category_count").alias("median_categories"),
        F.min("category_count").alias("min_categories"),
        F.max("category_count").alias("max_categories"),
        F.corr(F.col("category_count").cast("double"), F.col("total_hours")).alias("correlation"),
    )


def dominant_categories(sessions: DataFrame, n: int = 15) -> DataFrame:
    """How many users have each category as their largest."""
    key = F.struct((-F.col("hours")).alias("neg"), F.col("app_category").alias("category"))
    top = user_categories(sessions).groupBy("app_user_id").agg(F.min(key).alias("top"))
    counts = top.groupBy(F.col("top.category").alias("app_category")).agg(F.count(F.lit(1)).alias("users"))
    return counts.orderBy(F.col("users").desc(), "app_category").limit(n)


def category_cooccurrence(sessions: DataFrame) -> DataFrame:
    """Unordered category pairs used by one user on one day, counted.

    User-days are first collapsed to their distinct category sets with a
    count; pairs are formed once per distinct set, not per user-day.
    """
    rows = sessions.where(F.col("app_user_id").isNotNull() & F.col("app_category").isNotNull())
    sets = rows.groupBy("app_user_id", F.to_date("last_time_used").alias("date")).agg(
        F.sort_array(F.collect_set("app_category")).alias("cats")
    )
    counted = sets.where(F.size("cats") > 1).groupBy("cats").agg(F.count(F.lit(1)).alias("n"))
    first = counted.select("cats", "n", F.posexplode("cats").alias("i", "category_1"))
    rest = first.withColumn("category_2", F.explode(F.slice("cats", F.col("i") + 2, F.size("cats"))))
    return rest.groupBy("category_1", "category_2").agg(F.sum("n").alias("count"))


def category_trend(sessions: DataFrame, n: int = 5) -> DataFrame:
    sums = sessions.groupBy(F.to_date("last_time_used").alias("date"), "app_category").agg(F.sum("total_time_ms").alias("ms"))
    rows = sums.join(largest(sums, n), "app_category", "left_semi")
    return rows.select("date", "app_category", (F.col("ms") / 3_600_000.0).alias("hours"))


def screentime_completeness(sessions: DataFrame) -> DataFrame:
    """Days with data over the global date range, total and mean daily hours per user."""
    rows = sessions.where(F.col("app_user_id").isNotNull()).withColumn("date", F.to_date("last_time_used"))
    daily = rows.groupBy("app_user_id", "date").agg(F.sum("total_time_ms").alias("total_time_ms"))
    days = F.datediff(daily.agg(F.max("date")).scalar(), daily.agg(F.min("date")).scalar()) + 1
    per_user = daily.groupBy("app_user_id").agg(
        F.count(F.lit(1)).alias("days_with_data"),
        hours().alias("total_hours"),
        (F.sum("total_time_ms") / (F.count(F.lit(1)) * F.lit(3_600_000.0))).alias("avg_daily_hours"),
    )
    return per_user.withColumn("total_days", days).withColumn(
        "completeness_pct", F.col("days_with_data") / F.col("total_days") * 100
    )


def insights(sessions: DataFrame) -> DataFrame:
    """One row of headline figures, from one pass: sums by (user, category), by clock hour and by weekday are grouping
    sets of one aggregation, and all figures are aggregates of its rows."""
    sets = sessions.select("app_user_id", "app_category", F.hour("last_time_used").alias("h"), F.weekday("last_time_used").alias("d"), "total_time_ms")
    sets = sets.groupingSets([["app_user_id", "app_category"], ["h"], ["d"]], "app_user_id", "app_category", "h", "d").agg(
        F.grouping_id().alias("set"), F.sum("total_time_ms").alias("ms"), F.count("total_time_ms").alias("n"))
    # Columns that a set leaves out are ones in its id: 0011, 1101, 1110.
    pairs, by_hour, by_day = (F.col("set") == x for x in (3, 13, 14))
    known = F.col("app_category").isNotNull()
    share = F.when(F.col("ms_user") > 0, F.col("ms_top") / F.col("ms_user") * 100).otherwise(0.0)
    # The rest runs on one row for each (user, category), hour and weekday.
    per_user = sets.where(pairs & known & F.col("app_user_id").isNotNull()).groupBy("app_user_id").agg(
        F.sum("ms").alias("ms_user"), F.max("ms").alias("ms_top"))
    focused = per_user.agg(F.count_if(share > 50)).scalar()
    kinds = sets.groupBy(F.when(pairs, F.lit("c")).when(by_hour, F.lit("h")).otherwise("d").alias("kind"),
                         F.when(pairs, F.col("app_category")).alias("app_category"), F.when(by_hour, F.col("h")).when(by_day, F.col("d")).alias("place")).agg(
        F.sum("ms").alias("ms"), F.sum("n").alias("n"), F.count("app_user_id").alias("users"))
    hours_ = F.round(F.col("ms") / F.lit(3_600_000.0), 2)
    category = (F.col("kind") == "c") & known
    ranked = F.sort_array(F.collect_list(F.when(category, F.struct((-hours_).alias("neg"), "app_category"))))  # one entry a category
    everything = F.aggregate("_ranked", F.lit(0.0), lambda t, e: t - e["neg"])
    top = kinds.agg(
        ranked.alias("_ranked"),
        F.min(F.when(category, F.struct((-F.col("users")).alias("neg"), "app_category"))).alias("_adopted"),
        F.min(F.when(F.col("kind") == "h", F.struct((-F.col("ms")).alias("neg"), "place"))).alias("_hour"),
        F.min(F.when(F.col("kind") == "d", F.struct((-F.col("ms")).alias("neg"), "place"))).alias("_day"),
        (F.sum(F.when(F.col("kind") == "c", F.col("ms"))) / F.sum(F.when(F.col("kind") == "c", F.col("n")))).alias("_mean"),
    )
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    parts = F.transform(F.slice("_ranked", 1, 3), lambda e: F.round(-e["neg"] / everything * 100, 2))
    return top.select(
        F.get("_ranked", F.lit(0))["app_category"].alias("top_category"),
        F.aggregate(parts, F.lit(0.0), lambda t, x: t + x).alias("top3_share"),
        F.size("_ranked").cast("long").alias("categories"),
        F.col("_adopted.app_category").alias("most_adopted"),
        F.col("_hour.place").alias("peak_hour"),
        F.element_at(names, F.col("_day.place") + 1).alias("peak_day"),
        focused.alias("focused_users"),
        (F.col("_mean") / F.lit(60000.0)).alias("mean_session_minutes"),
    )


def top_apps(sessions: DataFrame, categories: int = 6, apps: int = 5) -> DataFrame:
    """The largest apps inside each of the largest categories."""
    stats = sessions.groupBy("app_category", "app_name").agg(
        F.sum("total_time_ms").alias("ms"), hours().alias("hours"), F.count_distinct("app_user_id").alias("unique_users")
    )
    stats = stats.join(largest(stats, categories), "app_category", "left_semi").drop("ms")
    return keep_first(stats, ["app_category"], [F.col("hours").desc(), F.col("app_name")], apps, "place")


def submissions_by_hour(responses: DataFrame, ts: str, first: int = 5, last: int = 11) -> DataFrame:
    return filter_hour_band(responses, ts, first, last).groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("submissions"))


def class_summary(training: DataFrame, label: str, positive: str) -> DataFrame:
    """Rows, users and class balance per window of a training set."""
    hit = F.count_if(F.col(label) == positive)
    return training.groupBy("window_hours").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("app_user_id").alias("users"),
        hit.alias("positives"),
        F.count_if(F.col(label) != positive).alias("negatives"),
        (hit / F.count(F.lit(1)) * 100).alias("pct_positive"),
    )


def null_report(variants: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """Nulls and moments per metric of the raw and filled grids."""
    parts = None
    for name, df in variants.items():
        cells = ", ".join(f"'{m}', {m}" for m in metrics)
        long = df.select(F.expr(f"stack({len(metrics)}, {cells}) as (metric, value)")).withColumn("variant", F.lit(name))
        parts = long if parts is None else parts.unionByName(long)
    return parts.groupBy("metric", "variant").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def window_feature_summary(profiles: DataFrame) -> DataFrame:
    """Mean screentime and availability per window."""
    return profiles.groupBy("window_hours").agg(
        F.count(F.lit(1)).alias("timepoints"),
        F.avg("total_screentime").alias("mean_screentime"),
        (F.avg("data_available") * 100).alias("pct_available"),
    )


def top_window_categories(profiles: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent top categories per window."""
    counts = profiles.where(F.col("most_used_category").isNotNull()).groupBy("window_hours", "most_used_category").agg(
        F.count(F.lit(1)).alias("timepoints")
    )
    return keep_first(counts, ["window_hours"], [F.col("timepoints").desc(), F.col("most_used_category")], n, "place")


def subwindow_summary(features: DataFrame, pieces: int, n: int = 5) -> DataFrame:
    """Per piece: mean time, mean apps, availability and the ``n`` most frequent categories."""
    cells = ", ".join(
        f"{i}, most_used_category_sw{i}, most_used_category_time_sw{i}, num_apps_sw{i}" for i in range(pieces)
    )
    long = features.select(F.expr(f"stack({pieces}, {cells}) as (piece, category, minutes, apps)"))
    stats = long.groupBy("piece").agg(
        F.avg("minutes").alias("mean_minutes"),
        F.avg("apps").alias("mean_apps"),
        (F.count_if(F.col("apps") > 0) / F.count(F.lit(1)) * 100).alias("pct_available"),
    )
    counts = long.where(F.col("category").isNotNull()).groupBy("piece", "category").agg(F.count(F.lit(1)).alias("times"))
    top = keep_first(counts, ["piece"], [F.col("times").desc(), F.col("category")], n, "place")
    return stats.join(top, "piece", "left")


def label_distribution(df: DataFrame, label: str, value: str | None = None) -> DataFrame:
    """Rows and share per class, with moments of ``value`` when given."""
    n = F.count(F.lit(1))
    aggs = [n.alias("rows")]
    if value:
        aggs += [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    counts = df.groupBy(label).agg(*aggs)
    # One row per class.
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))
