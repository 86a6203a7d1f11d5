"""Scans, cleaning, time grids and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import value_column
from ..functions.payload import descriptive_name, detect_format, validate
from ..functions.taxonomy import EXACT_APPS, KEYWORD_CATEGORIES, SYSTEM_PREFIXES, categorize_apps, upsert_dimension
from ..functions.timecols import calendar_features, strict_timestamp
from ..operators import clean, fill, timegrid
from ..operators.align import map_participants
from ..session import shared_dir
from ..sources.catalog import Catalog, exclude_test_users, payload_scan, read_csv, write_csv
from .registry import query, sql

EVENTS = ["metric_events"]
VALUES_D = ["daily_steps", "daily_distance", "daily_calories", "daily_avg_speed"]
VALUES_H = ["hourly_steps", "hourly_distance", "hourly_calories", "hourly_avg_speed"]

DEDUP = """SELECT * FROM metric_events
  QUALIFY row_number() OVER (PARTITION BY metric, app_user_id, start_timestamp ORDER BY id) = 1"""


def grid_text(bucket: str, name: str, prefix: str, where: str = "TRUE") -> str:
    return f"""SELECT app_user_id, {bucket} AS {name},
      sum(value) FILTER (metric = 'steps') AS {prefix}_steps,
      sum(value) FILTER (metric = 'distance') AS {prefix}_distance,
      sum(value) FILTER (metric = 'calories') AS {prefix}_calories,
      avg(value) FILTER (metric = 'speed') AS {prefix}_avg_speed
    FROM dedup_events WHERE {where} GROUP BY 1, 2"""


HOURLY = grid_text("date_trunc('hour', start_timestamp)", "datetime", "hourly")
DAILY = grid_text("CAST(start_timestamp AS DATE)", "date", "daily")
WEEK = "CAST(date_trunc('week', {d}) AS DATE)"
WEEK_OF_DATE = WEEK.format(d="date")
GRID_PARTS = {"dedup_events": DEDUP, "hourly": HOURLY, "daily": DAILY}


def r6(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


DAILY_OUT = f"""app_user_id, date, {WEEK_OF_DATE} AS week_start,
  CAST(date - {WEEK_OF_DATE} AS INT) AS day_index, {r6(VALUES_D)}"""
HOURLY_OUT = f"""app_user_id, datetime, CAST(datetime AS DATE) AS date,
  {WEEK.format(d='datetime')} AS week_start,
  CAST(CAST(datetime AS DATE) - {WEEK.format(d='datetime')} AS INT) AS day_index,
  CAST(row_number() OVER (PARTITION BY app_user_id, CAST(datetime AS DATE) ORDER BY datetime) - 1 AS INT) AS hour_index,
  {r6(VALUES_H)}"""

# ------------------------------------------------------------------- sources

SCAN = sql("SELECT id, app_user_id, metric, round(value, 6) AS value, start_timestamp FROM metric_events", EVENTS)


@query("scan_metric_events", SCAN)
def scan_metric_events(b):
    catalog = Catalog(b.spark, b.root, {"metric_events": b.metric_events})
    return catalog.extract(["metric_events"])["metric_events"]


@query("csv_roundtrip", SCAN)
def csv_roundtrip(b):
    path = shared_dir(b.spark, "csv")
    write_csv(b.metric_events, path)
    return read_csv(b.spark, [path, path + "-absent"], b.metric_events.schema)


@query("exclude_test_users", sql("""SELECT id, app_user_id, metric, round(value, 6) AS value, start_timestamp
FROM metric_events WHERE app_user_id IS NULL OR app_user_id NOT IN (
  SELECT app_user_id FROM participant_map WHERE participant_id LIKE '%7')""", EVENTS + ["participant_map"]))
def exclude_test_users_query(b):
    return exclude_test_users(b.metric_events, b.participant_map, "%7")


@query("map_participant_ids", sql("""SELECT m.id, coalesce(p.participant_id, CAST(m.app_user_id AS VARCHAR)) AS app_user_id,
  m.metric FROM metric_events m LEFT JOIN participant_map p USING (app_user_id)""", EVENTS + ["participant_map"]))
def map_participant_ids(b):
    return map_participants(b.metric_events, b.participant_map).select("id", "app_user_id", "metric")


@query("payload_scan", sql("""SELECT id, CAST(octet_length(payload) AS INT) AS n_bytes FROM payloads
WHERE payload IS NOT NULL AND octet_length(payload) > 1000""", ["payloads"]))
def payload_scan_query(b):
    return payload_scan(b.payloads).select("id", F.octet_length("payload").alias("n_bytes"))


_M4A = " OR ".join(f"contains(h40, hex('{m}'))" for m in ("M4A ", "M4B ", "mp42", "isom"))
MANIFEST = {
    "heads": """SELECT *, octet_length(payload) AS n, left(hex(payload), 24) AS h24, left(hex(payload), 40) AS h40,
      left(hex(payload), 100) AS h100, left(hex(payload), 200) AS h200 FROM payloads""",
    "formats": f"""SELECT *, CASE WHEN n < 10 THEN 'unknown'
      WHEN contains(h40, hex('ftyp3gp')) THEN '3gp'
      WHEN contains(h24, hex('ftyp')) AND ({_M4A}) THEN 'm4a'
      WHEN starts_with(h40, hex('caff')) THEN 'caf'
      WHEN starts_with(h40, 'FFF') THEN 'aac'
      WHEN starts_with(h40, hex('RIFF')) AND contains(h40, hex('WAVE')) THEN 'wav'
      WHEN starts_with(h40, hex('ID3')) OR starts_with(h40, 'FFFB') THEN 'mp3'
      WHEN starts_with(h40, hex('#!AMR')) THEN 'amr' ELSE 'unknown' END AS format FROM heads""",
    "problems": """SELECT *, CASE WHEN n = 0 THEN 'No audio data'
      WHEN n < 1000 THEN 'Audio data too small (' || n || ' bytes)'
      WHEN format = 'm4a' AND NOT (contains(h100, hex('M4A ')) OR contains(h100, hex('mp42'))
        OR contains(h100, hex('isom')) OR contains(h200, hex('mdat'))) THEN 'Missing M4A audio markers' END AS problem
      FROM formats""",
}


@query("payload_manifest", sql("""SELECT id, format, problem IS NULL AS is_valid,
  coalesce(problem, 'Valid ' || upper(format) || ' file (' || format('{:,}', n) || ' bytes)') AS reason,
  'db_audio_' || id || '_survey_' || survey_response_id || '_q_' || audio_question_id || '_'
    || coalesce(strftime(coalesce(ts, created_at), '%Y%m%d_%H%M%S'), 'unknown_time') || '.'
    || CASE format WHEN 'unknown' THEN 'bin' ELSE format END AS file_name
FROM problems""", ["payloads"], MANIFEST))
def payload_manifest(b):
    rows = b.payloads.withColumn("format", detect_format(F.col("payload")))
    rows = rows.withColumns(validate(F.col("payload"), F.col("format")))
    name = descriptive_name(F.col("id"), F.col("survey_response_id"), F.col("audio_question_id"),
                            F.col("ts"), F.col("created_at"), F.col("format"))
    return rows.select("id", "format", "is_valid", "reason", name.alias("file_name"))


# ------------------------------------------------------------ names, categories

_NAMES = """CASE p_partkey % 7 WHEN 0 THEN concat('com.android.', replace(p_name, ' ', '.'))
  WHEN 1 THEN concat(p_name, '.Camera') WHEN 2 THEN concat('My', p_name, 'PHONE')
  WHEN 3 THEN concat('org.', p_name, '.wallet') WHEN 4 THEN 'com.ss.android.ugc.trill'
  WHEN 5 THEN concat(p_name, '.launcher') ELSE p_name END AS app_name"""


def _rule_case(column: str) -> str:
    out = ["CASE"]
    out += [f"WHEN {column} = '{k}' THEN '{v}'" for k, v in EXACT_APPS.items()]
    for category, words in KEYWORD_CATEGORIES:
        out.append(f"WHEN regexp_matches(lower({column}), '{'|'.join(words)}') THEN '{category}'")
    tests = " OR ".join(f"starts_with(lower({column}), '{p}')" for p in SYSTEM_PREFIXES)
    return " ".join(out + [f"WHEN {tests} THEN 'TOOLS' ELSE 'UNKNOWN' END"])


_DIM = f"SELECT DISTINCT {_NAMES}, concat('GAME_', p_brand) AS app_category FROM part WHERE p_size < 5"
_DIM = f"SELECT app_name, min(app_category) AS app_category FROM ({_DIM}) GROUP BY 1"
CATEGORY_PARTS = {"dim": _DIM, "apps": f"SELECT p_partkey, {_NAMES} FROM part"}


def _named_parts(b):
    apps = b.raw("part").selectExpr("p_partkey", _NAMES)
    dim = b.raw("part").where("p_size < 5").selectExpr(_NAMES, "concat('GAME_', p_brand) AS app_category")
    return apps, dim.groupBy("app_name").agg(F.min("app_category").alias("app_category"))


@query("categorize_apps", sql(f"""SELECT p_partkey, app_name, CASE WHEN starts_with(c, 'GAME_') THEN 'GAMES' ELSE c END AS app_category
FROM (SELECT a.*, coalesce(d.app_category, {_rule_case('a.app_name')}) AS c FROM apps a LEFT JOIN dim d USING (app_name))""", [], CATEGORY_PARTS))
def categorize_apps_query(b):
    apps, dim = _named_parts(b)
    return categorize_apps(apps, dim)


@query("category_dim_upsert", sql(f"""SELECT app_name, app_category FROM dim UNION ALL
SELECT app_name, {_rule_case('app_name')} AS app_category
FROM (SELECT DISTINCT app_name FROM apps WHERE app_name NOT IN (SELECT app_name FROM dim))""", [], CATEGORY_PARTS))
def category_dim_upsert(b):
    apps, dim = _named_parts(b)
    return upsert_dimension(dim, apps)


# ------------------------------------------------------------------ cleaning

@query("parse_strict_ts", """SELECT event_id, ts AS parsed FROM events WHERE event_id % 3 = 0""")
def parse_strict_ts(b):
    text = F.expr("""CASE event_id % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')
      WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') ELSE concat('x', event_type) END""")
    rows = b.raw("events").select("event_id", strict_timestamp(text).alias("parsed"))
    return rows.where(F.col("parsed").isNotNull())


@query("dedup_start", sql("""SELECT id, app_user_id, hour_start FROM (
  SELECT id, app_user_id, date_trunc('hour', start_timestamp) AS hour_start FROM metric_events)
QUALIFY row_number() OVER (PARTITION BY app_user_id, hour_start ORDER BY id) = 1""", EVENTS))
def dedup_start(b):
    rows = b.metric_events.select("id", "app_user_id", timegrid.time_key("H", "start_timestamp").alias("hour_start"))
    return clean.dedup_start(rows, "hour_start")


@query("temporal_features", sql("""SELECT survey_response_id, CAST(hour(survey_ts) AS INT) AS hour_of_day,
  CAST(isodow(survey_ts) - 1 AS INT) AS day_of_week, CAST(isodow(survey_ts) > 5 AS INT) AS is_weekend,
  CAST(isodow(survey_ts) <= 5 AS INT) AS is_weekday,
  CASE WHEN hour(survey_ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(survey_ts) BETWEEN 12 AND 16 THEN 'afternoon'
       WHEN hour(survey_ts) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS time_of_day FROM surveys""", ["surveys"]))
def temporal_features(b):
    return b.surveys.select("survey_response_id", *[c.alias(k) for k, c in calendar_features(F.col("survey_ts")).items()])


SESSIONS = ["screentime", "screentime_app"]
_START = "last_time_used - to_milliseconds(total_time_ms)"
APP_PARTS = {
    "joined": """SELECT a.*, s.app_user_id, s.start_time, s.end_time FROM screentime_app a
      LEFT JOIN screentime s ON a.screentime_id = s.id""",
    "unrepeated": """SELECT * FROM joined WHERE NOT coalesce(regexp_matches(lower(app_name), 'launcher|controller'), FALSE)
      QUALIFY row_number() OVER (PARTITION BY app_user_id, start_time, end_time, app_name, total_time_ms, last_time_used
      ORDER BY screentime_id, line) = 1""",
    "timed": f"SELECT *, {_START} AS derived, total_time_ms / 1000.0 AS secs FROM unrepeated",
    "ordered": """SELECT *, row_number() OVER (PARTITION BY app_user_id ORDER BY derived, screentime_id, line, app_name, total_time_ms) = 1
      AND derived < start_time AND last_time_used < TIMESTAMP '2026-02-26' AS wrong FROM timed""",
    "app_sessions": """SELECT app_user_id, app_name, screentime_id, line,
      CASE WHEN wrong THEN last_time_used ELSE derived END AS calculated_start_time,
      CASE WHEN wrong THEN last_time_used + to_milliseconds(total_time_ms) ELSE last_time_used END AS last_time_used,
      total_time_ms, secs AS total_time_seconds, wrong FROM ordered""",
    "latest": """SELECT * FROM joined
      QUALIFY row_number() OVER (PARTITION BY screentime_id, app_name ORDER BY last_time_used DESC NULLS LAST,
      line DESC, total_time_ms DESC, app_category) = 1""",
    "categorized": """SELECT *, total_time_ms / 60000.0 AS total_time_minutes FROM latest
      WHERE NOT coalesce(regexp_matches(lower(app_name), 'launcher|controller'), FALSE)""",
}


def app_sessions_of(b):
    return clean.app_sessions(b.screentime_app, b.screentime)


def categorized_of(b):
    return clean.categorized_sessions(b.screentime_app, b.screentime)


@query("app_sessions", sql("""SELECT app_user_id, app_name, calculated_start_time, last_time_used, total_time_ms,
  round(total_time_seconds, 6) AS total_time_seconds FROM app_sessions""", SESSIONS, APP_PARTS))
def app_sessions(b):
    return app_sessions_of(b)


@query("categorized_sessions", sql("""SELECT screentime_id, line, app_user_id, app_name, app_category, start_time, last_time_used,
  round(total_time_minutes, 6) AS total_time_minutes FROM categorized""", SESSIONS, APP_PARTS))
def categorized_sessions(b):
    return categorized_of(b).select("screentime_id", "line", "app_user_id", "app_name", "app_category", "start_time",
                                    "last_time_used", "total_time_minutes")


@query("latest_cumulative", sql("SELECT screentime_id, app_name, line, last_time_used, total_time_ms FROM latest", SESSIONS, APP_PARTS))
def latest_cumulative(b):
    return clean.latest_cumulative(b.screentime_app).select("screentime_id", "app_name", "line", "last_time_used", "total_time_ms")


@query("first_session_repair", sql("""SELECT screentime_id, line, calculated_start_time, last_time_used
FROM app_sessions WHERE wrong""", SESSIONS, APP_PARTS))
def first_session_repair(b):
    repaired = clean.repaired_sessions(b.screentime_app, b.screentime).where("was_first")
    return repaired.select("screentime_id", "line", "calculated_start_time", "last_time_used")


@query("gap_repair", sql("""SELECT id, app_user_id, previous_end, end_time,
  CASE WHEN epoch_us(start_time) - epoch_us(previous_end) <= 120000000 THEN previous_end ELSE start_time END AS start_time
FROM (SELECT *, lag(end_time) OVER (PARTITION BY app_user_id ORDER BY start_time, id) AS previous_end FROM screentime)""", ["screentime"]))
def gap_repair(b):
    return clean.repair_gaps(b.screentime)


# ---------------------------------------------------------------- time grids

STEPS = """SELECT * FROM metric_events WHERE metric = 'steps'
  QUALIFY row_number() OVER (PARTITION BY app_user_id, start_timestamp ORDER BY id) = 1"""


def _steps(b):
    return b.metric_events.where("metric = 'steps'").drop("metric")


def _aggregates(b, unit):
    return timegrid.bucket_metric(_steps(b), ["sum", "mean", "min", "max", "count", "median"], unit, value="value")


_AGGS = ", ".join(f"round({f}(value), 6) AS value_{n}" for n, f in
                  [("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("median", "median")])


@query("metric_hourly", sql(f"""SELECT app_user_id, date_trunc('hour', start_timestamp) AS time_key,
  {_AGGS}, CAST(count(value) AS BIGINT) AS value_count FROM steps GROUP BY 1, 2""", EVENTS, {"steps": STEPS}))
def metric_hourly(b):
    return _aggregates(b, "H")


@query("metric_daily", sql(f"""SELECT app_user_id, CAST(start_timestamp AS DATE) AS time_key,
  {_AGGS}, CAST(count(value) AS BIGINT) AS value_count FROM steps GROUP BY 1, 2""", EVENTS, {"steps": STEPS}))
def metric_daily(b):
    return _aggregates(b, "D")


@query("daily_health", sql(f"SELECT {DAILY_OUT} FROM daily", EVENTS, GRID_PARTS))
def daily_health(b):
    return timegrid.daily_health(b.metric_events)


@query("daily_health_user", sql(f"SELECT {DAILY_OUT} FROM daily WHERE app_user_id = 8", EVENTS, GRID_PARTS))
def daily_health_user(b):
    return timegrid.daily_health(b.metric_events, app_user_id=8)


@query("hourly_health", sql(f"SELECT {HOURLY_OUT} FROM hourly", EVENTS, GRID_PARTS))
def hourly_health(b):
    tables = {m: b.metric_events.where(F.col("metric") == m).drop("metric") for m in timegrid.HEALTH_METRICS}
    assert all(value_column(t) == "value" for t in tables.values())
    return timegrid.hourly_health(timegrid.tag_metrics(tables))


_RANGE = "start_timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'"


@query("hourly_health_range", sql(f"SELECT {HOURLY_OUT} FROM hourly", EVENTS, {
    "dedup_events": DEDUP, "hourly": grid_text("date_trunc('hour', start_timestamp)", "datetime", "hourly", _RANGE)}))
def hourly_health_range(b):
    return timegrid.hourly_health(b.metric_events, date_range=("2024-01-05", "2024-01-12"))


def weekly_parts(metric: str, name: str) -> dict[str, str]:
    """Independent form: densify days, then average per week."""
    return {
        f"{name}_days": f"""SELECT app_user_id, CAST(start_timestamp AS DATE) AS d, sum(value) AS v
          FROM dedup_events WHERE metric = '{metric}' GROUP BY 1, 2""",
        f"{name}_dense": f"""SELECT app_user_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d
          FROM {name}_days GROUP BY 1""",
        f"{name}_weekly": f"""SELECT app_user_id, CAST(date_trunc('week', d) AS DATE) AS week_start, avg(coalesce(v, 0)) AS {name}
          FROM {name}_dense LEFT JOIN {name}_days USING (app_user_id, d) GROUP BY 1, 2""",
    }


def metric_of(b, metric: str):
    return b.metric_events.where(F.col("metric") == metric).drop("metric")


@query("weekly_avg", sql("SELECT app_user_id, week_start, round(avg_daily_steps, 6) AS avg_daily_steps FROM avg_daily_steps_weekly",
                         EVENTS, {"dedup_events": DEDUP} | weekly_parts("steps", "avg_daily_steps")))
def weekly_avg(b):
    return timegrid.weekly_average(metric_of(b, "steps"))


@query("hourly_screentime", sql("""SELECT app_user_id, datetime, CAST(datetime AS DATE) AS date,
  CAST(date_trunc('week', datetime) AS DATE) AS week_start, CAST(isodow(datetime) - 1 AS INT) AS day_index,
  CAST(row_number() OVER (PARTITION BY app_user_id, CAST(datetime AS DATE) ORDER BY datetime) - 1 AS INT) AS hour_index,
  round(s, 6) AS hourly_screentime
FROM (SELECT app_user_id, date_trunc('hour', calculated_start_time) AS datetime, sum(total_time_seconds) AS s
      FROM app_sessions WHERE app_user_id IS NOT NULL GROUP BY 1, 2)""", SESSIONS, APP_PARTS))
def hourly_screentime(b):
    return timegrid.hourly_screentime(app_sessions_of(b))


@query("daily_screentime", sql("""SELECT app_user_id, date, CAST(date_trunc('week', date) AS DATE) AS week_start,
  CAST(isodow(date) - 1 AS INT) AS day_index, round(sum(p), 6) AS parent_seconds, round(sum(a), 6) AS app_seconds
FROM (SELECT app_user_id, CAST(start_time AS DATE) AS date, epoch(end_time) - epoch(start_time) AS p, NULL AS a FROM screentime
      UNION ALL SELECT app_user_id, CAST(calculated_start_time AS DATE), NULL, total_time_seconds FROM app_sessions)
WHERE app_user_id IS NOT NULL GROUP BY 1, 2, 3, 4""", SESSIONS, APP_PARTS))
def daily_screentime(b):
    parents = b.screentime.withColumn("seconds", clean.seconds_between(F.col("start_time"), F.col("end_time")))
    keys = ["app_user_id", "date", "week_start", "day_index"]
    a = timegrid.daily_screentime(parents, "start_time", "seconds").withColumnRenamed("daily_screentime", "parent_seconds")
    c = timegrid.daily_screentime(app_sessions_of(b)).withColumnRenamed("daily_screentime", "app_seconds")
    return a.join(c, keys, "full").select(*keys, "parent_seconds", "app_seconds")


_PIVOT = ", ".join(f"round(coalesce(sum(hourly_steps) FILTER (hour(datetime) = {h}), 0), 6) AS hour_{h}" for h in range(24))


@query("day_hour_pivot", sql(f"SELECT app_user_id, CAST(datetime AS DATE) AS date, {_PIVOT} FROM hourly GROUP BY 1, 2", EVENTS, GRID_PARTS))
def day_hour_pivot(b):
    return timegrid.day_hour_pivot(timegrid.hourly_health(b.metric_events), "hourly_steps")


# ---------------------------------------------------------------------- fills

_W = "PARTITION BY app_user_id ORDER BY date"
FILL_PARTS = GRID_PARTS | {
    "placed": f"SELECT *, row_number() OVER ({_W}) AS pos FROM daily",
    "sides": "SELECT *, " + ", ".join(
        f"""last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0_{c},
        last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0_{c},
        first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1_{c},
        first_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1_{c}"""
        for c in VALUES_D) + " FROM placed",
    "linear": "SELECT app_user_id, date, " + ", ".join(
        f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN v0_{c} IS NULL THEN v1_{c} WHEN v1_{c} IS NULL THEN v0_{c}
        ELSE v0_{c} + (v1_{c} - v0_{c}) * (pos - p0_{c}) / (p1_{c} - p0_{c}) END AS {c}""" for c in VALUES_D) + " FROM sides",
    "nearest": "SELECT app_user_id, date, " + ", ".join(f"coalesce({c}, v0_{c}, v1_{c}) AS {c}" for c in VALUES_D) + " FROM sides",
}
_FLAGS = ", ".join(f"d.{c} IS NULL AS {c}_is_filled" for c in VALUES_D)


@query("fill_interpolate", sql("SELECT l.app_user_id, l.date, " + ", ".join(f"round(l.{c}, 6) AS {c}" for c in VALUES_D) + f", {_FLAGS}"
                               " FROM linear l JOIN daily d USING (app_user_id, date)", EVENTS, FILL_PARTS))
def fill_interpolate(b):
    grid = timegrid.daily_health(b.metric_events).drop("week_start", "day_index")
    return fill.fill_gaps(grid, VALUES_D, "interpolate", ["app_user_id"], "date", flag=True)


@query("fill_ffill_bfill", sql(f"SELECT app_user_id, date, {r6(VALUES_D)} FROM nearest", EVENTS, FILL_PARTS))
def fill_ffill_bfill(b):
    return timegrid.daily_health(b.metric_events, fill="ffill_bfill").drop("week_start", "day_index")


@query("fill_zero", sql("SELECT app_user_id, date, " + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in VALUES_D) + " FROM daily", EVENTS, GRID_PARTS))
def fill_zero(b):
    return timegrid.daily_health(b.metric_events, fill="zero").drop("week_start", "day_index")


def _imputed(how: str) -> str:
    return "SELECT app_user_id, date, " + ", ".join(
        f"round(coalesce({c}, (SELECT {how}({c}) FROM daily)), 6) AS {c}" for c in VALUES_D) + " FROM daily"


@query("impute_mean", sql(_imputed("avg"), EVENTS, GRID_PARTS))
def impute_mean(b):
    grid = timegrid.daily_health(b.metric_events).drop("week_start", "day_index")
    return fill.impute(grid, VALUES_D, "mean")


@query("impute_median", sql(_imputed("median"), EVENTS, GRID_PARTS))
def impute_median(b):
    grid = timegrid.daily_health(b.metric_events).drop("week_start", "day_index")
    return fill.impute(grid, VALUES_D, "median")


@query("impute_drop", sql(f"SELECT app_user_id, date, {r6(VALUES_D)} FROM daily WHERE "
                          + " AND ".join(f"{c} IS NOT NULL" for c in VALUES_D), EVENTS, GRID_PARTS))
def impute_drop(b):
    grid = timegrid.daily_health(b.metric_events).drop("week_start", "day_index")
    return fill.impute(grid, VALUES_D, "drop")
