"""Survey alignment, lookback joins and category windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, lookback, metrics, reports, surveys, timegrid
from ..operators.mlprep import split_temporal
from .grid_queries import DEDUP, EVENTS, GRID_PARTS, HOURLY_OUT, DAILY_OUT, VALUES_D, r6, weekly_parts
from .registry import query, sql

SURVEYS = ["surveys"]
LABEL = "risk_label"

ONE_PER_DAY = """SELECT * FROM surveys WHERE risk_label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY app_user_id, CAST(survey_ts AS DATE) ORDER BY survey_ts, survey_response_id) = 1"""


def hourly_of(b):
    return timegrid.hourly_health(b.metric_events)


def one_per_day_of(b):
    return surveys.one_per_day(b.surveys, LABEL)


# --------------------------------------------------------------- survey rows

@query("one_survey_per_day", sql("SELECT survey_response_id, app_user_id, survey_id, survey_ts, risk_label FROM o", SURVEYS, {"o": ONE_PER_DAY}))
def one_survey_per_day(b):
    return one_per_day_of(b).select("survey_response_id", "app_user_id", "survey_id", "survey_ts", LABEL)


PROPAGATED = """SELECT * REPLACE (CASE WHEN bool_or(risk_label = 'at_risk') OVER (PARTITION BY app_user_id) THEN 'at_risk'
  ELSE risk_label END AS risk_label) FROM surveys"""


@query("propagate_labels", sql("SELECT survey_response_id, app_user_id, survey_ts, risk_label FROM p", SURVEYS, {"p": PROPAGATED}))
def propagate_labels(b):
    return surveys.propagate_positive(b.surveys, LABEL, "at_risk").select("survey_response_id", "app_user_id", "survey_ts", LABEL)


@query("propagation_summary", sql("""SELECT CAST(count(DISTINCT s.app_user_id) AS BIGINT) AS users,
  CAST(count(DISTINCT s.app_user_id) FILTER (s.risk_label = 'at_risk') AS BIGINT) AS positive_users,
  CAST(count(*) FILTER (s.risk_label = 'at_risk') AS BIGINT) AS positive_rows_before,
  (SELECT CAST(count(*) AS BIGINT) FROM p WHERE risk_label = 'at_risk') AS positive_rows_after FROM surveys s""", SURVEYS, {"p": PROPAGATED}))
def propagation_summary(b):
    return surveys.propagation_summary(b.surveys, LABEL, "at_risk")


TEMPORAL = """SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY app_user_id) AS n FROM surveys
  WINDOW w AS (PARTITION BY app_user_id ORDER BY survey_ts, survey_response_id)"""
TEMPORAL_SPLIT = """SELECT *, n > 1 AND rn > least(greatest(floor(n * (CAST(1 AS DOUBLE) - CAST(0.3 AS DOUBLE))), 1), n - 1) AS is_test FROM t"""
_METRICS = """SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS specificity,
  CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS precision_negative,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
  CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2.0 * tn / (2 * tn + fp + fn) END AS f1_negative,
  tp + fn AS support_positive, tn + fp AS support_negative FROM counts"""
COUNTS = """CAST(count(*) FILTER (y_true = 1 AND y_pred = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (y_true = 0 AND y_pred = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (y_true = 1 AND y_pred = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (y_true = 0 AND y_pred = 0) AS BIGINT) AS tn"""


def metric_parts(counts: str) -> dict[str, str]:
    return {"counts": counts, "measured": _METRICS}


METRIC_OUT = """tp, fp, fn, tn, support_positive, support_negative,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(specificity, 6) AS specificity, round(precision_negative, 6) AS precision_negative,
  round(specificity, 6) AS recall_negative, round(f1_negative, 6) AS f1_negative,
  round((f1 * support_positive + f1_negative * support_negative) / (tp + fp + fn + tn), 6) AS f1_weighted,
  round((recall + specificity) / 2, 6) AS balanced_accuracy"""


@query("persistence_baseline", sql(f"SELECT {METRIC_OUT} FROM measured", SURVEYS, {
    "t": TEMPORAL, "split": TEMPORAL_SPLIT,
    "pred": """SELECT is_test, CAST(risk_label = 'at_risk' AS INT) AS y_true, CAST(first_value(risk_label) OVER
      (PARTITION BY app_user_id ORDER BY survey_ts, survey_response_id) = 'at_risk' AS INT) AS y_pred FROM split""",
} | metric_parts(f"SELECT {COUNTS} FROM pred WHERE is_test")))
def persistence_baseline(b):
    split = split_temporal(b.surveys, "survey_response_id", "survey_ts")
    scored = surveys.first_label_baseline(split, LABEL).where("is_test").select(
        (F.col(LABEL) == "at_risk").cast("int").alias("y_true"), (F.col("predicted") == "at_risk").cast("int").alias("y_pred")
    )
    return metrics.classification_metrics(metrics.confusion(scored, []))


# ------------------------------------------------------------ weekly and as-of

RESPONSES = ["survey_response", "answer"]
PHQ9_PARTS = {
    "phq9_items": """SELECT survey_response_id, question_id, max(answer) AS answer FROM answer
      WHERE question_id BETWEEN 59 AND 67 GROUP BY 1, 2""",
    "phq9": """SELECT r.id AS survey_response_id, r.app_user_id, r.survey_ts, CAST(sum(CAST(answer AS INT)) AS BIGINT) AS phq9_total_score
      FROM survey_response r JOIN phq9_items i ON i.survey_response_id = r.id GROUP BY 1, 2, 3""",
    "phq9_labelled": """SELECT *, CASE WHEN phq9_total_score < 10 THEN 'not_depressed' ELSE 'depressed' END AS severity_label,
      CASE WHEN phq9_total_score <= 4 THEN 'minimal' WHEN phq9_total_score <= 9 THEN 'mild' WHEN phq9_total_score <= 14 THEN 'moderate'
           WHEN phq9_total_score <= 19 THEN 'moderately_severe' ELSE 'severe' END AS severity_level FROM phq9""",
}
WEEKLY_LABELS = """SELECT app_user_id, CAST(date_trunc('week', survey_ts) AS DATE) AS week_start, severity_label, phq9_total_score FROM phq9_labelled
  QUALIFY row_number() OVER (PARTITION BY app_user_id, date_trunc('week', survey_ts) ORDER BY survey_ts, survey_response_id) = 1"""


def phq9_of(b):
    return surveys.phq9_scores(b.survey_response, b.answer)


@query("weekly_labels", sql("SELECT * FROM weekly_labels", RESPONSES, PHQ9_PARTS | {"weekly_labels": WEEKLY_LABELS}))
def weekly_labels(b):
    return surveys.weekly_first(phq9_of(b))


# Weekly labels on the event users: the first survey of each user's week.
EVENT_WEEK_LABELS = """SELECT app_user_id, CAST(date_trunc('week', survey_ts) AS DATE) AS week_start, risk_label AS severity_label,
  survey_response_id AS phq9_total_score FROM surveys
  QUALIFY row_number() OVER (PARTITION BY app_user_id, date_trunc('week', survey_ts) ORDER BY survey_ts, survey_response_id) = 1"""


def event_week_labels(b):
    scored = b.surveys.select("survey_response_id", "app_user_id", "survey_ts", F.col(LABEL).alias("severity_label"),
                              F.col("survey_response_id").alias("phq9_total_score"))
    return surveys.weekly_first(scored)


_WEEKLY = timegrid.WEEKLY_METRICS
_WEEKLY_PARTS = {"dedup_events": DEDUP, "labels_w": EVENT_WEEK_LABELS}
for _metric, _name in _WEEKLY.items():
    _WEEKLY_PARTS |= weekly_parts(_metric, _name)


@query("weekly_health_labels", sql("SELECT app_user_id, week_start, " + r6(list(_WEEKLY.values())) + ", severity_label, phq9_total_score FROM labels_w "
                                   + " ".join(f"JOIN {n}_weekly USING (app_user_id, week_start)" for n in _WEEKLY.values()),
                                   EVENTS + SURVEYS, _WEEKLY_PARTS))
def weekly_health_labels(b):
    return align.join_weekly([timegrid.weekly_health(b.metric_events)], event_week_labels(b))


_LABELLED = GRID_PARTS | {"labels_w": EVENT_WEEK_LABELS}


@query("daily_health_labels", sql(f"SELECT g.*, severity_label, phq9_total_score FROM (SELECT {DAILY_OUT} FROM daily) g JOIN labels_w USING (app_user_id, week_start)",
                                  EVENTS + SURVEYS, _LABELLED))
def daily_health_labels(b):
    return align.join_week_label(timegrid.daily_health(b.metric_events), event_week_labels(b))


@query("hourly_health_labels", sql(f"SELECT g.*, severity_label, phq9_total_score FROM (SELECT {HOURLY_OUT} FROM hourly) g JOIN labels_w USING (app_user_id, week_start)",
                                   EVENTS + SURVEYS, _LABELLED))
def hourly_health_labels(b):
    return align.join_week_label(hourly_of(b), event_week_labels(b))


SESSION_EVENTS = ["category_sessions"]
SESSION_HOURLY = """SELECT app_user_id, date_trunc('hour', last_time_used) AS datetime, sum(total_time_minutes * 60) AS s
  FROM category_sessions GROUP BY 1, 2"""


def session_hourly_of(b):
    rows = b.category_sessions.withColumns(
        {"calculated_start_time": F.col("last_time_used"), "total_time_seconds": F.col("total_time_minutes") * 60}
    )
    return timegrid.hourly_screentime(rows)


@query("hourly_screentime_labels", sql("""SELECT app_user_id, datetime, week_start, round(s, 6) AS hourly_screentime, severity_label, phq9_total_score
FROM (SELECT *, CAST(date_trunc('week', datetime) AS DATE) AS week_start FROM session_hourly) JOIN labels_w USING (app_user_id, week_start)""",
                                       SESSION_EVENTS + SURVEYS, {"session_hourly": SESSION_HOURLY, "labels_w": EVENT_WEEK_LABELS}))
def hourly_screentime_labels(b):
    joined = align.join_week_label(session_hourly_of(b), event_week_labels(b))
    return joined.drop("date", "day_index", "hour_index")


@query("asof_next_survey", sql(f"""SELECT g.app_user_id, g.datetime, {r6(["hourly_steps", "hourly_distance", "hourly_calories", "hourly_avg_speed"])},
  s.survey_ts, s.survey_response_id, s.risk_label
FROM hourly g ASOF JOIN surveys s ON g.app_user_id = s.app_user_id AND g.datetime <= s.survey_ts""", EVENTS + SURVEYS, GRID_PARTS))
def asof_next_survey(b):
    grid = timegrid.metric_grid(b.metric_events, "H").withColumnRenamed("time_key", "datetime")
    return align.next_survey(grid, b.surveys.drop("survey_id"))


# --------------------------------------------------------------- hour slots

HOURS = 12


def slot_sql(refs: str, hours: int, fill: str | None, mode: str = "rounded") -> dict[str, str]:
    diff = "(epoch_us(r.ref_ts) - epoch_us(g.datetime)) / 3600000000.0"
    slot = f"CAST(round_even({diff}, 0) AS INT)" if mode == "rounded" else f"CAST(ceil({diff}) - 1 AS INT)"
    return {
        "refs": refs,
        "pairs": f"""SELECT r.survey_response_id, {diff} AS before, {slot} AS slot, g.hourly_steps AS v FROM refs r JOIN hourly g
          ON g.app_user_id = r.app_user_id AND g.datetime >= r.ref_ts - to_hours({hours}) AND g.datetime < r.ref_ts""",
    }


def slot_columns(hours: int, fill: str | None, window: str | None = None) -> str:
    out = []
    for i in range(hours):
        total = f"round(coalesce(sum(v) FILTER (slot = {i}), 0), 6)"
        if fill != "zero":
            total = f"CASE WHEN count(*) FILTER (slot = {i}) > 0 THEN {total} END"
        if window:
            total = f"CASE WHEN {window} > {i} THEN {total} END"
        out.append(f"{total} AS hour_{i}")
    return ", ".join(out)


_OWN_TIME = "SELECT *, survey_ts AS ref_ts FROM surveys"
STANDARD = "SELECT *, date_trunc('day', survey_ts) + INTERVAL 9 HOUR AS ref_ts FROM one_per_day"


@query("lookback_hour_slots", sql(f"""SELECT survey_response_id, app_user_id, ref_ts, {slot_columns(HOURS, None)}
FROM refs JOIN pairs USING (survey_response_id) GROUP BY 1, 2, 3""", EVENTS + SURVEYS, GRID_PARTS | slot_sql(_OWN_TIME, HOURS, None)))
def lookback_hour_slots(b):
    return lookback.lookback_slots(hourly_of(b), b.surveys, "hourly_steps", HOURS, fill=None)


@query("lookback_hour_slots_elapsed", sql(f"""SELECT survey_response_id, app_user_id, ref_ts, {slot_columns(HOURS, 'zero')}
FROM refs JOIN pairs USING (survey_response_id) GROUP BY 1, 2, 3""", EVENTS + SURVEYS, GRID_PARTS | slot_sql(_OWN_TIME, HOURS, "zero", "elapsed")))
def lookback_hour_slots_elapsed(b):
    return lookback.lookback_slots(hourly_of(b), b.surveys, "hourly_steps", HOURS, mode="elapsed")


STD_PARTS = GRID_PARTS | {"one_per_day": ONE_PER_DAY} | slot_sql(STANDARD, HOURS, "zero")


def standard_slots(b, hours: int = HOURS):
    return lookback.lookback_slots(hourly_of(b), one_per_day_of(b), "hourly_steps", hours, standardized=True, keep=[LABEL])


STD_SLOTS = f"""SELECT survey_response_id, app_user_id, ref_ts, risk_label, {slot_columns(HOURS, 'zero')}
  FROM refs JOIN pairs USING (survey_response_id) GROUP BY 1, 2, 3, 4"""


@query("lookback_hour_slots_std", sql(STD_SLOTS, EVENTS + SURVEYS, STD_PARTS))
def lookback_hour_slots_std(b):
    return standard_slots(b)


_TRAIN_WINDOWS = lookback.TRAINING_WINDOWS
MULTI_SLOTS = f"""SELECT survey_response_id, app_user_id, ref_ts, risk_label, CAST(w AS INT) AS window_hours, {slot_columns(12, 'zero', 'w')}
  FROM refs JOIN pairs USING (survey_response_id) JOIN (SELECT unnest({_TRAIN_WINDOWS}) AS w) ON before <= w GROUP BY 1, 2, 3, 4, w"""


def training_of(b):
    return lookback.multiwindow_slots(hourly_of(b), one_per_day_of(b), "hourly_steps", keep=[LABEL])


@query("multiwindow_training", sql(MULTI_SLOTS, EVENTS + SURVEYS, STD_PARTS))
def multiwindow_training(b):
    return training_of(b)


@query("window_class_summary", sql("""SELECT window_hours, CAST(count(*) AS BIGINT) AS samples, CAST(count(DISTINCT app_user_id) AS BIGINT) AS users,
  CAST(count(*) FILTER (risk_label = 'at_risk') AS BIGINT) AS positives, CAST(count(*) FILTER (risk_label <> 'at_risk') AS BIGINT) AS negatives,
  round(count(*) FILTER (risk_label = 'at_risk') / count(*) * 100, 6) AS pct_positive FROM training GROUP BY 1""",
                                   EVENTS + SURVEYS, STD_PARTS | {"training": MULTI_SLOTS}))
def window_class_summary(b):
    return reports.class_summary(training_of(b), LABEL, "at_risk")


@query("sequence_features", sql(f"""SELECT survey_response_id, CAST({HOURS} - 1 - i AS INT) AS pos, v AS value, CAST(risk_label = 'at_risk' AS INT) AS label_index
FROM (SELECT survey_response_id, risk_label, unnest(range({HOURS})) AS i, unnest([{", ".join(f"hour_{i}" for i in range(HOURS))}]) AS v FROM slots)""",
                                EVENTS + SURVEYS, STD_PARTS | {"slots": STD_SLOTS}))
def sequence_features(b):
    seq = lookback.sequences(standard_slots(b), HOURS)
    label = (F.col(LABEL) == "at_risk").cast("int").alias("label_index")
    return seq.select("survey_response_id", label, F.posexplode("sequence").alias("pos", "value"))


# -------------------------------------------------------------- sub-windows

LOOKBACK, SIZE = 12, 3


def piece_parts(refs: str, lookback_hours: int = LOOKBACK, size: int = SIZE) -> dict[str, str]:
    return {
        "refs": refs,
        "used": f"""SELECT r.survey_response_id, CAST(floor((epoch_us(r.ref_ts) - epoch_us(s.last_time_used)) / ({size} * 3600000000.0)) AS INT) AS piece,
          s.* FROM refs r JOIN category_sessions s ON s.app_user_id = r.app_user_id
          AND s.last_time_used <= r.ref_ts AND s.last_time_used > r.ref_ts - to_hours({lookback_hours})""",
        "cats": """SELECT survey_response_id, piece, app_category, sum(total_time_minutes) AS m FROM used WHERE app_category IS NOT NULL GROUP BY 1, 2, 3
          QUALIFY row_number() OVER (PARTITION BY survey_response_id, piece ORDER BY round(sum(total_time_minutes), 6) DESC, app_category) = 1""",
        "apps_used": "SELECT survey_response_id, piece, count(DISTINCT app_name) AS n FROM used GROUP BY 1, 2",
    }


def piece_columns(lookback_hours: int = LOOKBACK, size: int = SIZE) -> str:
    return ", ".join(
        f"""max(c.app_category) FILTER (c.piece = {i}) AS most_used_category_sw{i},
        round(coalesce(max(c.m) FILTER (c.piece = {i}), 0), 6) AS most_used_category_time_sw{i},
        CAST(coalesce(max(a.n) FILTER (a.piece = {i}), 0) AS INT) AS num_apps_sw{i}""" for i in range(lookback_hours // size))


PIECES = f"""SELECT r.survey_response_id, r.app_user_id, r.ref_ts, r.risk_label, {piece_columns()} FROM refs r
  LEFT JOIN apps_used a USING (survey_response_id) LEFT JOIN cats c ON c.survey_response_id = r.survey_response_id AND c.piece = a.piece
  GROUP BY 1, 2, 3, 4"""
PIECE_VIEWS = SESSION_EVENTS + SURVEYS
STD_PIECES = {"one_per_day": ONE_PER_DAY} | piece_parts(STANDARD)


def subwindows_of(b):
    return lookback.subwindow_features(b.category_sessions, one_per_day_of(b), LOOKBACK, SIZE, keep=[LABEL])


@query("subwindow_features", sql(PIECES, PIECE_VIEWS, STD_PIECES))
def subwindow_features(b):
    return subwindows_of(b)


@query("subwindow_features_actual", sql(PIECES, PIECE_VIEWS, piece_parts(_OWN_TIME)))
def subwindow_features_actual(b):
    return lookback.subwindow_features(b.category_sessions, b.surveys, LOOKBACK, SIZE, standardized=False, keep=[LABEL])


_SW_COLUMNS = [f"{c}_sw{i}" for i in range(LOOKBACK // SIZE) for c in ("most_used_category", "most_used_category_time", "num_apps")]
COMBINED = STD_PARTS | {"slots": STD_SLOTS} | {k: v for k, v in STD_PIECES.items() if k != "one_per_day" and k != "refs"} | {
    "pieces": PIECES,
    "combined": f"SELECT s.*, {', '.join('p.' + c for c in _SW_COLUMNS)} FROM slots s JOIN pieces p USING (survey_response_id)",
}
COMBINED_VIEWS = EVENTS + SURVEYS + SESSION_EVENTS


def combined_of(b, propagate: bool = False):
    """Hour slots and sub-windows of one survey per user-day, optionally with propagated labels."""
    joined = align.join_features(standard_slots(b), subwindows_of(b))
    return surveys.propagate_positive(joined, LABEL, "at_risk") if propagate else joined


@query("combined_features", sql("SELECT * FROM combined", COMBINED_VIEWS, COMBINED))
def combined_features(b):
    return combined_of(b)


@query("combined_features_propagated", sql("""SELECT * REPLACE (CASE WHEN bool_or(risk_label = 'at_risk') OVER (PARTITION BY app_user_id)
  THEN 'at_risk' ELSE risk_label END AS risk_label) FROM combined""", COMBINED_VIEWS, COMBINED))
def combined_features_propagated(b):
    return combined_of(b, propagate=True)


@query("daily_steps_labels", sql(f"""SELECT app_user_id, date, {r6(VALUES_D)}, survey_response_id, survey_ts, risk_label
FROM daily JOIN (SELECT *, CAST(survey_ts AS DATE) AS date FROM one_per_day) USING (app_user_id, date)""",
                                 EVENTS + SURVEYS, GRID_PARTS | {"one_per_day": ONE_PER_DAY}))
def daily_steps_labels(b):
    daily = timegrid.daily_health(b.metric_events).drop("week_start", "day_index")
    joined = align.join_same_day(daily, one_per_day_of(b).drop("survey_id"), LABEL)
    return align.require_two_classes(joined, LABEL)


# ---------------------------------------------------------- category windows

_WINDOWS = lookback.CATEGORY_WINDOWS
PROFILE_PARTS = {
    "windows": f"SELECT unnest({_WINDOWS}) AS w",
    "refs": "SELECT DISTINCT screentime_id, app_user_id, last_time_used AS ref_ts FROM category_sessions",
    "used": """SELECT r.screentime_id, w, s.app_category, s.app_name, s.total_time_minutes AS m FROM refs r JOIN category_sessions s
      ON s.app_user_id = r.app_user_id AND s.last_time_used <= r.ref_ts AND s.last_time_used >= r.ref_ts - to_hours(168)
      JOIN windows ON s.last_time_used >= r.ref_ts - to_hours(w)""",
    "cats": """SELECT screentime_id, w, app_category, sum(m) AS m, row_number() OVER (PARTITION BY screentime_id, w
      ORDER BY round(sum(m), 6) DESC, app_category) AS rn FROM used GROUP BY 1, 2, 3""",
    "shares": """SELECT screentime_id, w, sum(m) AS total, count(*) AS n, max(m) FILTER (rn = 1) AS top_m,
      max(app_category) FILTER (rn = 1) AS c1, max(app_category) FILTER (rn = 2) AS c2, max(app_category) FILTER (rn = 3) AS c3,
      max(m) FILTER (rn = 2) AS m2, max(m) FILTER (rn = 3) AS m3 FROM cats GROUP BY 1, 2""",
    "entropies": """SELECT screentime_id, w, -sum(CASE WHEN m > 0 THEN m / total * ln(m / total) ELSE 0 END) AS h
      FROM cats JOIN shares USING (screentime_id, w) WHERE total > 0 GROUP BY 1, 2""",
    "app_counts": "SELECT screentime_id, w, count(DISTINCT app_name) AS n_apps FROM used GROUP BY 1, 2",
    "profiles": """SELECT r.screentime_id, r.app_user_id, r.ref_ts, CAST(w AS INT) AS window_hours,
      round(s.total, 6) AS total_screentime, CAST(n_apps AS INT) AS num_apps_used, 1 AS data_available, c1 AS most_used_category,
      round(top_m, 6) AS most_used_category_time, CAST(n AS INT) AS num_categories_used,
      round(CASE WHEN n > 1 AND s.total > 0 THEN h / ln(n) ELSE 0 END, 6) AS category_diversity,
      round(CASE WHEN s.total > 0 THEN top_m / s.total ELSE 0 END, 6) AS most_used_category_proportion,
      c1 AS category_rank_1, c2 AS category_rank_2, c3 AS category_rank_3,
      round(top_m, 6) AS category_rank_1_time, round(m2, 6) AS category_rank_2_time, round(m3, 6) AS category_rank_3_time
      FROM refs r JOIN shares s USING (screentime_id) LEFT JOIN entropies USING (screentime_id, w) JOIN app_counts USING (screentime_id, w)""",
}


def profiles_of(b):
    events = b.category_sessions.select("screentime_id", "app_user_id", F.col("last_time_used").alias("ref_ts"))
    return lookback.category_windows(b.category_sessions, events)


@query("multiwindow_category", sql("SELECT * FROM profiles", SESSION_EVENTS, PROFILE_PARTS))
def multiwindow_category(b):
    return profiles_of(b)


@query("feature_summary", sql("""SELECT window_hours, CAST(count(*) AS BIGINT) AS timepoints, round(avg(total_screentime), 6) AS mean_screentime,
  round(avg(data_available) * 100, 6) AS pct_available FROM profiles GROUP BY 1""", SESSION_EVENTS, PROFILE_PARTS))
def feature_summary(b):
    return reports.window_feature_summary(profiles_of(b))


@query("window_top_categories", sql("""SELECT window_hours, most_used_category, CAST(count(*) AS BIGINT) AS timepoints,
  CAST(row_number() OVER (PARTITION BY window_hours ORDER BY count(*) DESC, most_used_category) AS INT) AS place FROM profiles
  WHERE most_used_category IS NOT NULL GROUP BY 1, 2 QUALIFY place <= 10""", SESSION_EVENTS, PROFILE_PARTS))
def window_top_categories(b):
    return reports.top_window_categories(profiles_of(b))


_LONG = " UNION ALL ".join(
    f"SELECT {i} AS piece, most_used_category_sw{i} AS c, most_used_category_time_sw{i} AS m, num_apps_sw{i} AS a FROM pieces" for i in range(4))


@query("subwindow_summary", sql("""SELECT s.piece, mean_minutes, mean_apps, pct_available, category, times, place FROM
  (SELECT piece, round(avg(m), 6) AS mean_minutes, round(avg(a), 6) AS mean_apps, round(count(*) FILTER (a > 0) / count(*) * 100, 6) AS pct_available FROM long GROUP BY 1) s
  LEFT JOIN (SELECT piece, c AS category, CAST(count(*) AS BIGINT) AS times, CAST(row_number() OVER (PARTITION BY piece ORDER BY count(*) DESC, c) AS INT) AS place
             FROM long WHERE c IS NOT NULL GROUP BY 1, 2 QUALIFY place <= 5) t USING (piece)""", PIECE_VIEWS, STD_PIECES | {"pieces": PIECES, "long": _LONG}))
def subwindow_summary(b):
    return reports.subwindow_summary(subwindows_of(b), LOOKBACK // SIZE)


# -------------------------------------------------------------------- sweep

SWEEP_PARTS = {
    "one_per_day": ONE_PER_DAY,
    "refs": STANDARD,
    "grid": """SELECT CAST(lb AS INT) AS lookback_hours, CAST(sw AS INT) AS subwindow_hours FROM range(1, 31) a(lb), range(1, 31) c(sw) WHERE lb % sw = 0""",
    "ages": """SELECT r.survey_response_id, (epoch_us(r.ref_ts) - epoch_us(s.last_time_used)) / 3600000000.0 AS age, s.* FROM refs r
      JOIN category_sessions s ON s.app_user_id = r.app_user_id AND s.last_time_used <= r.ref_ts AND s.last_time_used > r.ref_ts - to_hours(30)""",
    "used": """SELECT survey_response_id, lookback_hours, subwindow_hours, CAST(floor(age / subwindow_hours) AS INT) AS piece,
      app_category, app_name, total_time_minutes AS m FROM ages JOIN grid ON age < lookback_hours""",
    "cats": """SELECT survey_response_id, lookback_hours, subwindow_hours, piece, app_category, sum(m) AS m FROM used GROUP BY 1, 2, 3, 4, 5
      QUALIFY row_number() OVER (PARTITION BY survey_response_id, lookback_hours, subwindow_hours, piece ORDER BY round(sum(m), 6) DESC, app_category) = 1""",
    "sweep": """SELECT survey_response_id, lookback_hours, subwindow_hours, piece, app_category AS most_used_category, round(m, 6) AS most_used_category_time, num_apps
      FROM cats JOIN (SELECT survey_response_id, lookback_hours, subwindow_hours, piece, CAST(count(DISTINCT app_name) AS INT) AS num_apps FROM used GROUP BY 1, 2, 3, 4)
      USING (survey_response_id, lookback_hours, subwindow_hours, piece)""",
}


@query("sweep_features", sql("SELECT * FROM sweep", PIECE_VIEWS, SWEEP_PARTS))
def sweep_features(b):
    return lookback.sweep_features(b.category_sessions, one_per_day_of(b))


@query("sweep_grid", sql("""SELECT g.lookback_hours, g.subwindow_hours, CAST(g.lookback_hours // g.subwindow_hours AS INT) AS n_subwindows,
  CAST(count(DISTINCT survey_response_id) AS BIGINT) AS surveys_with_data, CAST(count(survey_response_id) AS BIGINT) AS pieces_filled
FROM grid g LEFT JOIN sweep s USING (lookback_hours, subwindow_hours) GROUP BY 1, 2, 3""", PIECE_VIEWS, SWEEP_PARTS))
def sweep_grid(b):
    return lookback.sweep_coverage(b.category_sessions, one_per_day_of(b))


_HEAT = ", ".join(f"round(avg(most_used_category_time) FILTER (lookback_hours = {i}), 6) AS \"{i}\"" for i in range(1, 31))


@query("sweep_heatmap", sql(f"SELECT subwindow_hours, {_HEAT} FROM sweep GROUP BY 1", PIECE_VIEWS, SWEEP_PARTS))
def sweep_heatmap(b):
    rows = lookback.sweep_features(b.category_sessions, one_per_day_of(b))
    # Decimals: a mean of doubles follows the order of the rows.
    rows = rows.withColumn("most_used_category_time", F.col("most_used_category_time").cast(lookback.EXACT))
    return metrics.pivot_metric(rows, "subwindow_hours", "lookback_hours", list(range(1, 31)), "most_used_category_time")
