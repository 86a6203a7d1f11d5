"""Usage reports, completeness panels and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, clean, fill, reports, spines, timegrid
from ..operators.clean import study_days
from .align_queries import LABEL, ONE_PER_DAY, SURVEYS, one_per_day_of
from .grid_queries import APP_PARTS, EVENTS, FILL_PARTS, GRID_PARTS, SESSIONS, VALUES_D, categorized_of
from .registry import query, sql

START, END, UPDATE = "2024-01-01", "2024-01-31", "2024-01-15"
HOURS = "sum(total_time_ms) / 3600000.0"
PARTS = APP_PARTS | {
    "stats": f"""SELECT app_category, round({HOURS}, 2) AS total_hours, CAST(count(*) AS BIGINT) AS record_count,
      CAST(count(DISTINCT app_user_id) AS BIGINT) AS unique_users, CAST(count(DISTINCT app_name) AS BIGINT) AS unique_apps
      FROM categorized WHERE app_category IS NOT NULL GROUP BY 1""",
    "shares": """SELECT *, round(total_hours / sum(total_hours) OVER () * 100, 2) AS pct_of_total,
      round(total_hours / unique_users, 2) AS avg_hours_per_user FROM stats""",
    "cats": f"""SELECT app_category, {HOURS} AS hours, row_number() OVER (ORDER BY {HOURS} DESC, app_category) AS place
      FROM categorized WHERE app_category IS NOT NULL GROUP BY 1""",
    "user_cats": f"SELECT app_user_id, app_category, {HOURS} AS hours FROM categorized WHERE app_user_id IS NOT NULL AND app_category IS NOT NULL GROUP BY 1, 2",
    "behavior": """SELECT app_user_id, CAST(count(*) AS BIGINT) AS category_count, sum(hours) AS total_hours,
      CASE WHEN sum(hours) > 0 THEN max(hours) / sum(hours) * 100 ELSE 0 END AS top_category_pct FROM user_cats GROUP BY 1""",
}


def cat_sql(body: str) -> str:
    return sql(body, SESSIONS, PARTS)


@query("category_stats", cat_sql("SELECT * FROM shares"))
def category_stats(b):
    return reports.category_stats(categorized_of(b))


@query("top_categories_other", cat_sql("SELECT CASE WHEN place <= 3 THEN app_category ELSE 'Other' END AS category, round(sum(hours), 6) AS hours FROM cats GROUP BY 1"))
def top_categories_other(b):
    return reports.top_with_other(categorized_of(b), 3)


_BY_HOUR = ", ".join(f"round(coalesce(sum(total_time_ms) FILTER (hour(last_time_used) = {h}) / 3600000.0, 0), 6) AS h{h}" for h in range(24))


@query("category_by_hour", cat_sql(f"SELECT app_category, {_BY_HOUR} FROM categorized WHERE app_category IN (SELECT app_category FROM cats WHERE place <= 10) GROUP BY 1"))
def category_by_hour(b):
    return reports.category_by_hour(categorized_of(b))


@query("category_by_weekday", cat_sql(f"""SELECT CAST(d AS INT) AS weekday, list_extract({reports.WEEKDAYS}, CAST(d AS INT) + 1) AS day_name, c.app_category, round(coalesce(h, 0), 6) AS hours
FROM cats c CROSS JOIN range(7) t(d) LEFT JOIN (SELECT app_category, isodow(last_time_used) - 1 AS d, {HOURS} AS h FROM categorized GROUP BY 1, 2) USING (app_category, d) WHERE place <= 10"""))
def category_by_weekday(b):
    return reports.category_by_weekday(categorized_of(b))


@query("user_concentration", cat_sql("SELECT app_user_id, category_count, round(total_hours, 6) AS total_hours, round(top_category_pct, 6) AS top_category_pct FROM behavior"))
def user_concentration(b):
    return reports.user_behavior(categorized_of(b))


@query("user_diversity", cat_sql("""SELECT CAST(count(*) AS BIGINT) AS users, round(avg(category_count), 6) AS mean_categories, round(median(category_count), 6) AS median_categories,
  min(category_count) AS min_categories, max(category_count) AS max_categories, round(corr(category_count, total_hours), 6) AS correlation FROM behavior"""))
def user_diversity(b):
    return reports.diversity_summary(categorized_of(b))


@query("dominant_category", cat_sql("""SELECT app_category, CAST(count(*) AS BIGINT) AS users FROM (SELECT * FROM user_cats
  QUALIFY row_number() OVER (PARTITION BY app_user_id ORDER BY hours DESC, app_category) = 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""))
def dominant_category(b):
    return reports.dominant_categories(categorized_of(b))


@query("category_cooccurrence", sql("""SELECT a.app_category AS category_1, b.app_category AS category_2, CAST(count(*) AS BIGINT) AS count
FROM used a JOIN used b ON a.app_user_id = b.app_user_id AND a.date = b.date AND a.app_category < b.app_category GROUP BY 1, 2""", SESSIONS,
                                     PARTS | {"used": "SELECT DISTINCT app_user_id, CAST(last_time_used AS DATE) AS date, app_category FROM categorized"}))
def category_cooccurrence(b):
    return reports.category_cooccurrence(categorized_of(b))


@query("category_trend", cat_sql(f"""SELECT CAST(last_time_used AS DATE) AS date, app_category, round({HOURS}, 6) AS hours FROM categorized
WHERE app_category IN (SELECT app_category FROM cats WHERE place <= 5) GROUP BY 1, 2"""))
def category_trend(b):
    return reports.category_trend(categorized_of(b))


_DAILY_USE = "SELECT app_user_id, CAST(last_time_used AS DATE) AS date, sum(total_time_ms) AS ms FROM categorized WHERE app_user_id IS NOT NULL GROUP BY 1, 2"


@query("screentime_completeness", sql("""SELECT app_user_id, CAST(count(*) AS BIGINT) AS days_with_data, round(sum(ms) / 3600000.0, 6) AS total_hours, round(sum(ms) / (count(*) * 3600000.0), 6) AS avg_daily_hours,
  CAST(any_value(n) AS INT) AS total_days, round(count(*) / any_value(n) * 100, 6) AS completeness_pct
FROM used CROSS JOIN (SELECT max(date) - min(date) + 1 AS n FROM used) GROUP BY 1""", SESSIONS, PARTS | {"used": _DAILY_USE}))
def screentime_completeness(b):
    return reports.screentime_completeness(categorized_of(b))


# The panel runs on the event sessions: 30 days for every user.
EVENT_DAYS = "SELECT app_user_id, CAST(last_time_used AS DATE) AS date, sum(total_time_minutes) AS v FROM category_sessions GROUP BY 1, 2"
_SPAN = "SELECT CAST(unnest(generate_series((SELECT min(date) FROM {t}), (SELECT max(date) FROM {t}), INTERVAL 1 DAY)) AS DATE) AS date"


@query("presence_panel", sql("""SELECT u.app_user_id, d.date, round(coalesce(v, 0), 6) AS total_time_minutes
FROM (SELECT DISTINCT app_user_id FROM used) u CROSS JOIN span d LEFT JOIN used USING (app_user_id, date)""", ["category_sessions"],
                             {"used": EVENT_DAYS, "span": _SPAN.format(t="used")}))
def presence_panel(b):
    rows = b.category_sessions.withColumn("date", F.to_date("last_time_used"))
    return spines.date_panel(rows, "date", "total_time_minutes")


@query("category_insights", cat_sql(f"""SELECT (SELECT app_category FROM shares ORDER BY total_hours DESC, app_category LIMIT 1) AS top_category,
  (SELECT round(sum(pct_of_total), 6) FROM (SELECT * FROM shares ORDER BY total_hours DESC, app_category LIMIT 3)) AS top3_share,
  (SELECT CAST(count(*) AS BIGINT) FROM shares) AS categories,
  (SELECT app_category FROM shares ORDER BY unique_users DESC, app_category LIMIT 1) AS most_adopted,
  (SELECT CAST(hour(last_time_used) AS INT) FROM categorized GROUP BY 1 ORDER BY sum(total_time_ms) DESC, 1 LIMIT 1) AS peak_hour,
  (SELECT list_extract({reports.WEEKDAYS}, CAST(isodow(last_time_used) AS INT)) FROM categorized GROUP BY isodow(last_time_used) ORDER BY sum(total_time_ms) DESC, isodow(last_time_used) LIMIT 1) AS peak_day,
  (SELECT CAST(count(*) AS BIGINT) FROM behavior WHERE top_category_pct > 50) AS focused_users,
  (SELECT round(avg(total_time_ms / 60000.0), 6) FROM categorized) AS mean_session_minutes"""))
def category_insights(b):
    return reports.insights(categorized_of(b))


@query("top_apps", cat_sql(f"""SELECT app_category, app_name, round({HOURS}, 6) AS hours, CAST(count(DISTINCT app_user_id) AS BIGINT) AS unique_users,
  CAST(row_number() OVER (PARTITION BY app_category ORDER BY {HOURS} DESC, app_name) AS INT) AS place
FROM categorized WHERE app_category IN (SELECT app_category FROM cats WHERE place <= 6) GROUP BY 1, 2 QUALIFY place <= 5"""))
def top_apps(b):
    return reports.top_apps(categorized_of(b))


# ---------------------------------------------------------------- completeness

def _spine(value: str) -> dict[str, str]:
    return {
        "in_study": f"""SELECT *, CAST(CAST(start_timestamp AS DATE) - DATE '{START}' + 1 AS INT) AS day FROM metric_events
          WHERE start_timestamp >= DATE '{START}' AND start_timestamp < DATE '{END}'""",
        "sums": f"SELECT app_user_id, day, {value} AS v FROM in_study GROUP BY 1, 2",
        "spine": f"""SELECT app_user_id, day, CAST(DATE '{START}' + day - 1 AS DATE) AS date, coalesce(v, 0) AS v
          FROM (SELECT DISTINCT app_user_id FROM sums) CROSS JOIN (SELECT CAST(unnest(range(1, (SELECT max(day) FROM sums) + 1)) AS INT) AS day)
          LEFT JOIN sums USING (app_user_id, day)""",
    }


COUNT_SPINE = _spine("CAST(count(*) AS BIGINT)")


def counts_of(b):
    return spines.daily_counts(b.metric_events, "start_timestamp", START, END)


@query("daily_totals_spine", sql("SELECT app_user_id, day, date, round(v, 6) AS total FROM spine", EVENTS, _spine("sum(value)")))
def daily_totals_spine(b):
    return spines.daily_totals(b.metric_events, "start_timestamp", "value", START, END)


@query("daily_counts_spine", sql("SELECT app_user_id, day, date, CAST(v AS BIGINT) AS count FROM spine", EVENTS, COUNT_SPINE))
def daily_counts_spine(b):
    return counts_of(b)


SURVEY_SPINE = {k.replace("in_study", "in_s").replace("sums", "sums_s").replace("spine", "spine_s"):
                v.replace("metric_events", "surveys").replace("start_timestamp", "survey_ts").replace("in_study", "in_s").replace("FROM sums", "FROM sums_s")
                .replace("JOIN sums", "JOIN sums_s") for k, v in _spine("1").items()}


@query("submission_flags", sql("SELECT app_user_id, day, date, CAST(v AS INT) AS submitted FROM spine_s", SURVEYS, SURVEY_SPINE))
def submission_flags(b):
    return spines.daily_flags(b.surveys, "survey_ts", START, END)


@query("status_matrix", sql("""SELECT app_user_id, day, state, list_extract(['none', 'data', 'survey', 'both'], state + 1) AS status FROM (
  SELECT u.app_user_id, d.day, CAST(coalesce(a.v > 0, FALSE) AS INT) + 2 * CAST(coalesce(s.v > 0, FALSE) AS INT) AS state
  FROM (SELECT app_user_id FROM spine UNION SELECT app_user_id FROM spine_s) u CROSS JOIN (SELECT day FROM spine UNION SELECT day FROM spine_s) d
  LEFT JOIN spine a USING (app_user_id, day) LEFT JOIN spine_s s USING (app_user_id, day))""", EVENTS + SURVEYS, COUNT_SPINE | SURVEY_SPINE))
def status_matrix(b):
    days = [study_days(df, ts, START, END).withColumn("n", F.lit(1)) for df, ts in ((b.metric_events, "start_timestamp"), (b.surveys, "survey_ts"))]
    return spines.status_matrix(*days, "n", "n")


@query("completeness_score", sql("""SELECT app_user_id, CAST(count(*) FILTER (v > 0) AS BIGINT) AS days_with_data,
  round(count(*) FILTER (v > 0) / max(day) * 100, 6) AS completeness_percentage, CAST(sum(v) AS BIGINT) AS total_records FROM spine GROUP BY 1""", EVENTS, COUNT_SPINE))
def completeness_score(b):
    return spines.completeness(counts_of(b))


@query("completeness_hist", sql("""SELECT bin, bin_from, bin_to, CAST(count(pct) AS BIGINT) AS users
FROM (VALUES (0, 0, 25), (1, 25, 50), (2, 50, 75), (3, 75, 90), (4, 90, 100)) e(bin, bin_from, bin_to)
LEFT JOIN (SELECT count(*) FILTER (v > 0) / max(day) * 100 AS pct FROM spine GROUP BY app_user_id)
  ON pct >= bin_from AND (pct < bin_to OR (bin = 4 AND pct = 100)) GROUP BY 1, 2, 3""", EVENTS, COUNT_SPINE))
def completeness_hist(b):
    return spines.histogram(spines.completeness(counts_of(b)), "completeness_percentage")


@query("daily_participation", sql("SELECT day, date, CAST(count(DISTINCT app_user_id) FILTER (v > 0) AS BIGINT) AS participants FROM spine GROUP BY 1, 2", EVENTS, COUNT_SPINE))
def daily_participation(b):
    return spines.participation(counts_of(b))


@query("availability", sql("SELECT app_user_id, day, CAST(v > 0 AS INT) AS available FROM spine", EVENTS, COUNT_SPINE))
def availability(b):
    return spines.availability(counts_of(b))


@query("user_totals", sql("SELECT app_user_id, CAST(sum(v) AS BIGINT) AS total FROM spine GROUP BY 1", EVENTS, COUNT_SPINE))
def user_totals(b):
    return spines.user_totals(counts_of(b), "count")


@query("three_users", sql("""SELECT unnest(CASE WHEN n = 1 THEN ['most', 'median', 'least'] WHEN rn = n AND rn = n // 2 + 1 THEN ['most', 'median']
  WHEN rn = n THEN ['most'] WHEN rn = n // 2 + 1 THEN ['median'] ELSE ['least'] END) AS role, app_user_id, total
FROM (SELECT *, row_number() OVER (ORDER BY total, app_user_id) AS rn, count(*) OVER () AS n FROM (SELECT app_user_id, CAST(sum(v) AS BIGINT) AS total FROM spine GROUP BY 1))
WHERE rn IN (1, n, n // 2 + 1)""", EVENTS, COUNT_SPINE))
def three_users(b):
    return spines.three_users(spines.user_totals(counts_of(b), "count"))


@query("hour_profile", sql("""SELECT CAST(h AS INT) AS hour, CAST(count(id) AS BIGINT) AS total_records, round(coalesce(sum(value), 0), 6) AS total_value
FROM range(24) t(h) LEFT JOIN metric_events ON hour(start_timestamp) = h GROUP BY 1""", EVENTS))
def hour_profile(b):
    return spines.hour_profile(b.metric_events, "start_timestamp", "value")


PROFILE_USERS = [3, 5, 8, 13, 21]


@query("hour_profile_users", sql(f"""SELECT u AS app_user_id, CAST(h AS INT) AS hour, CAST(count(id) AS BIGINT) AS total_records, round(coalesce(sum(value), 0), 6) AS total_value
FROM range(24) t(h) CROSS JOIN (SELECT CAST(unnest({PROFILE_USERS}) AS BIGINT) AS u) LEFT JOIN metric_events ON hour(start_timestamp) = h AND app_user_id = u GROUP BY 1, 2""", EVENTS))
def hour_profile_users(b):
    return spines.hour_profile_users(b.metric_events, "start_timestamp", "value", PROFILE_USERS)


@query("users_after_update", sql("""SELECT app_user_id, date, round(daily_steps, 6) AS daily_steps FROM daily
WHERE app_user_id IN (SELECT app_user_id FROM daily WHERE date >= DATE '2024-01-30')""", EVENTS, GRID_PARTS))
def users_after_update(b):
    daily = timegrid.daily_health(b.metric_events).select("app_user_id", "date", "daily_steps")
    return clean.users_seen_since(daily, "2024-01-30")


_STEP_DAYS = {"used": "SELECT app_user_id, CAST(start_timestamp AS DATE) AS date, sum(value) AS v FROM metric_events GROUP BY 1, 2"}


@query("update_impact_daily", sql(f"""SELECT app_user_id, date, round(coalesce(v, 0), 6) AS value
FROM (SELECT DISTINCT app_user_id FROM used WHERE date >= DATE '{UPDATE}') CROSS JOIN span LEFT JOIN used USING (app_user_id, date)""", EVENTS,
                                  _STEP_DAYS | {"span": _SPAN.format(t="used")}))
def update_impact_daily(b):
    rows = b.metric_events.withColumn("date", F.to_date("start_timestamp"))
    users = rows.where(F.col("date") >= F.lit(UPDATE).cast("date")).select("app_user_id").distinct()
    return spines.date_panel(rows, "date", "value", users)


@query("update_impact_hourly", sql(f"""SELECT app_user_id, hour, round(v, 6) AS hourly_total FROM (SELECT DISTINCT app_user_id FROM used)
CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '{UPDATE}' - INTERVAL 7 DAY, TIMESTAMP '{UPDATE}' + INTERVAL 8 DAY, INTERVAL 1 HOUR)) AS hour)
LEFT JOIN used USING (app_user_id, hour)""", EVENTS, {"used": f"""SELECT app_user_id, date_trunc('hour', start_timestamp) AS hour, sum(value) AS v FROM metric_events
  WHERE start_timestamp >= TIMESTAMP '{UPDATE}' - INTERVAL 7 DAY AND start_timestamp < TIMESTAMP '{UPDATE}' + INTERVAL 8 DAY GROUP BY 1, 2"""}))
def update_impact_hourly(b):
    return spines.update_hourly(b.metric_events, "start_timestamp", "value", UPDATE)


@query("submissions_by_hour", sql("""SELECT CAST(hour(survey_ts) AS INT) AS hour, CAST(count(*) AS BIGINT) AS submissions FROM surveys
WHERE hour(survey_ts) BETWEEN 5 AND 11 GROUP BY 1""", SURVEYS))
def submissions_by_hour(b):
    return reports.submissions_by_hour(b.surveys, "survey_ts")


_STATS = " UNION ALL ".join(
    f"""SELECT '{c}' AS metric, '{v}' AS variant, CAST(count(*) AS BIGINT) AS points, CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS nulls,
    round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM {t}"""
    for c in VALUES_D for v, t in (("raw", "daily"), ("interpolated", "linear"), ("filled", "nearest")))


@query("null_report", sql(_STATS, EVENTS, FILL_PARTS))
def null_report(b):
    raw = timegrid.daily_health(b.metric_events)
    by = (["app_user_id"], "date")
    variants = {"raw": raw, "interpolated": fill.fill_gaps(raw, VALUES_D, "interpolate", *by), "filled": fill.fill_gaps(raw, VALUES_D, "ffill_bfill", *by)}
    return reports.null_report(variants, VALUES_D)


@query("label_distribution", sql("""SELECT risk_label, CAST(count(*) AS BIGINT) AS rows, round(avg(daily_steps), 6) AS mean, round(stddev_samp(daily_steps), 6) AS std,
  round(min(daily_steps), 6) AS min, round(max(daily_steps), 6) AS max, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM daily JOIN (SELECT *, CAST(survey_ts AS DATE) AS date FROM one_per_day) USING (app_user_id, date) GROUP BY 1""", EVENTS + SURVEYS,
                                 GRID_PARTS | {"one_per_day": ONE_PER_DAY}))
def label_distribution(b):
    joined = align.join_same_day(timegrid.daily_health(b.metric_events), one_per_day_of(b), LABEL)
    return reports.label_distribution(joined, LABEL, "daily_steps")
