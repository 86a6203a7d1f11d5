"""Survey scoring, coercion and risk labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.parse import clock_seconds, safe_int, sleep_hours, yes_no
from ..operators import surveys
from .align_queries import PHQ9_PARTS, RESPONSES, phq9_of
from .registry import query, sql

DAILY = ["survey_response", "daily_answer"]
_ITEMS = rules.DAILY_ITEMS
_WIDE_COLUMNS = ", ".join(f"max(answer) FILTER (question_id = {i}) AS q{i}" for i in _ITEMS)
WIDE = f"""SELECT r.id AS survey_response_id, r.app_user_id, r.survey_ts, max(r.survey_id) AS survey_id, {_WIDE_COLUMNS}
  FROM survey_response r JOIN daily_answer a ON a.survey_response_id = r.id WHERE r.survey_id IN (0, 1) GROUP BY 1, 2, 3"""


def _typed(item: int) -> str:
    if item in rules.YES_NO_ITEMS:
        return f"CASE q{item} WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS q{item}"
    if item in rules.CLOCK_ITEMS:
        return f"q{item}"
    return f"CAST(q{item} AS BIGINT) AS q{item}"


TYPED = f"""SELECT survey_response_id, app_user_id, survey_ts, survey_id, CAST(survey_ts AS DATE) AS survey_date,
  {", ".join(_typed(i) for i in _ITEMS)} FROM wide"""

_SCALED = [i for i in _ITEMS if i not in rules.CLOCK_ITEMS + [rules.SLEEP_QUALITY_ITEM]]


def _mean(item: int) -> str:
    if item in rules.YES_NO_ITEMS:
        return f"CASE WHEN avg(q{item}) >= 0.5 THEN 1 WHEN avg(q{item}) IS NOT NULL THEN 0 END AS q{item}"
    return f"avg(q{item}) AS q{item}"


_MORNING = ", ".join(f"m.q{i}" for i in rules.CLOCK_ITEMS + [rules.SLEEP_QUALITY_ITEM])
AVERAGED = f"""SELECT s.*, {_MORNING} FROM (
    SELECT app_user_id, survey_date, arg_min(survey_response_id, (survey_ts, survey_response_id)) AS survey_response_id,
      min(survey_ts) AS survey_ts, {", ".join(_mean(i) for i in _SCALED)} FROM typed GROUP BY 1, 2) s
  LEFT JOIN (SELECT * FROM typed WHERE survey_id = 0 QUALIFY row_number() OVER
    (PARTITION BY app_user_id, survey_date ORDER BY survey_ts, survey_response_id) = 1) m USING (app_user_id, survey_date)"""


def _total(items: list[int]) -> str:
    summed = " + ".join(f"coalesce(q{i}, 0)" for i in items)
    return f"CASE WHEN coalesce({', '.join(f'q{i}' for i in items)}) IS NOT NULL THEN {summed} END"


def _at_risk(test: str) -> str:
    return f"CASE WHEN {test} THEN 'at_risk' ELSE 'not_at_risk' END"


def _or(tests: list[str]) -> str:
    return " OR ".join(f"coalesce({t}, FALSE)" for t in tests)


_SECONDS = "(date_part('hour', CAST({c} AS TIME)) * 3600 + date_part('minute', CAST({c} AS TIME)) * 60)"
_GAP = f"({_SECONDS.format(c='q55')} - {_SECONDS.format(c='q54')})"


def scored_parts(source: str, averaged: bool) -> dict[str, str]:
    totals = ", ".join(f"{_total(items)} AS {name}" for name, items in rules.TOTALS.items())
    sleep = f"""CASE WHEN sleep_hours IS NULL AND q56 IS NULL THEN NULL
      ELSE {_at_risk(_or(['sleep_hours <= 5', 'sleep_hours >= 11', 'q56 <= 2']))} END"""
    if not averaged:
        sleep = f"CASE WHEN survey_id <> 0 THEN 'N/A' ELSE {sleep} END"
    thresholds = ", ".join(
        f"CASE WHEN {total} IS NOT NULL THEN {_at_risk(f'{total} {op} {limit}')} END AS {label}"
        for label, (total, op, limit) in rules.THRESHOLDS.items()
    )
    suicide = _or([f"q{i} >= 2" for i in (2, 3, 7)] + [f"q{i} = 1" for i in (5, 8, 12, 13)])
    harm = _or(["q9 >= 2"] + [f"q{i} = 1" for i in (11, 15, 16, 17, 18)])
    return {
        "totals": f"""SELECT *, {totals}, round(CASE WHEN {_GAP} <= 0 THEN {_GAP} + 86400 ELSE {_GAP} END / 3600.0, 3) AS sleep_hours FROM {source}""",
        "labels": f"SELECT *, {_at_risk(suicide)} AS suicide_risk_label, {_at_risk(harm)} AS self_harm_risk_label, {sleep} AS sleep_label, {thresholds} FROM totals",
    }


BASE = {"wide": WIDE, "typed": TYPED}
LABEL_OUT = ["suicide_risk_label", "self_harm_risk_label", "sleep_label", *rules.THRESHOLDS]


def labels_of(b, averaged: bool = False):
    return surveys.daily_labels(b.survey_response, b.daily_answer, averaged)


@query("answers_pivot", sql(f"SELECT survey_response_id, app_user_id, survey_ts, survey_id, {', '.join(f'q{i}' for i in _ITEMS)} FROM wide", DAILY, BASE))
def answers_pivot(b):
    return surveys.pivot_answers(b.survey_response, b.daily_answer, _ITEMS, [surveys.MORNING, surveys.AFTERNOON])


@query("survey_totals", sql(f"SELECT survey_response_id, {', '.join(f'CAST({t} AS BIGINT) AS {t}' for t in rules.TOTALS)} FROM totals", DAILY,
                            BASE | scored_parts("typed", False)))
def survey_totals(b):
    return labels_of(b).select("survey_response_id", *rules.TOTALS)


@query("risk_labels", sql(f"SELECT survey_response_id, app_user_id, survey_ts, sleep_hours, {', '.join(LABEL_OUT)} FROM labels", DAILY,
                          BASE | scored_parts("typed", False)))
def risk_labels(b):
    return labels_of(b).select("survey_response_id", "app_user_id", "survey_ts", "sleep_hours", *LABEL_OUT)


@query("daily_labels_averaged", sql(f"""SELECT survey_response_id, app_user_id, survey_date, survey_ts, sleep_hours,
  {', '.join(f'round({t}, 6) AS {t}' for t in rules.TOTALS)}, {', '.join(LABEL_OUT)} FROM labels""", DAILY,
                                    BASE | {"averaged": AVERAGED} | scored_parts("averaged", True)))
def daily_labels_averaged(b):
    return labels_of(b, averaged=True).select("survey_response_id", "app_user_id", "survey_date", "survey_ts", "sleep_hours", *rules.TOTALS, *LABEL_OUT)


_FIVE = ", ".join(f"max(answer) FILTER (question_id = {i}) AS q{i}" for i in (2, 3, 5, 7, 12))


@query("risk_labels_v2", sql(f"""SELECT survey_response_id, {_at_risk(_or([f'TRY_CAST(q{i} AS BIGINT) >= 2' for i in (2, 3, 5, 7)] + ["q12 = 'yes'"]))} AS suicide_risk_label FROM five""",
                             DAILY, {"five": f"""SELECT r.id AS survey_response_id, {_FIVE} FROM survey_response r JOIN daily_answer a ON a.survey_response_id = r.id
  WHERE r.survey_id IN (0, 1) AND question_id IN (2, 3, 5, 7, 12) GROUP BY 1"""}))
def risk_labels_v2(b):
    return surveys.five_item_labels(b.survey_response, b.daily_answer).select("survey_response_id", "suicide_risk_label")


@query("phq9_severity", sql("SELECT survey_response_id, app_user_id, phq9_total_score, severity_level, severity_label FROM phq9_labelled", RESPONSES, PHQ9_PARTS))
def phq9_severity(b):
    return phq9_of(b).select("survey_response_id", "app_user_id", "phq9_total_score", "severity_level", "severity_label")


# Typed-in answers in several spellings, from the event stream.
_RAW = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(CAST(floor(value) AS INT) AS STRING) WHEN 1 THEN concat(CAST(CAST(floor(value) AS INT) AS STRING), '.7')
  WHEN 2 THEN event_type WHEN 3 THEN concat(' ', CAST(CAST(floor(value) AS INT) AS STRING), ' ') END AS number_text,
  CASE event_id % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'F' WHEN 2 THEN 'maybe' WHEN 3 THEN 'TRUE' WHEN 4 THEN '0' WHEN 5 THEN 'y' END AS flag_text FROM {e}"""


@query("coerce_answers", f"""SELECT event_id, CAST(trunc(TRY_CAST(trim(number_text) AS DOUBLE)) AS BIGINT) AS number,
  CASE lower(trim(flag_text)) WHEN 'yes' THEN 1 WHEN 'y' THEN 1 WHEN 'true' THEN 1 WHEN 'f' THEN 0 WHEN '0' THEN 0 END AS flag
FROM ({_RAW.format(e='events')})""")
def coerce_answers(b):
    raw = b.spark.sql(_RAW, e=b.raw("events"))
    return raw.select("event_id", safe_int("number_text").alias("number"), yes_no("flag_text").alias("flag"))


@query("sleep_duration", sql("""SELECT id, s AS asleep_seconds, w AS awake_seconds, round(CASE WHEN w <= s THEN w - s + 86400 ELSE w - s END / 3600.0, 3) AS sleep_hours
FROM (SELECT id, CAST(epoch(CAST(coalesce(try_strptime(q54, '%I:%M %p'), try_strptime(q54, '%H:%M:%S'), try_strptime(q54, '%H:%M')) AS TIME)) AS INT) AS s,
  CAST(epoch(CAST(strptime(q55, '%I:%M%p') AS TIME)) AS INT) AS w FROM clock_answers)""", ["clock_answers"]))
def sleep_duration(b):
    q54, q55 = F.col("q54"), F.col("q55")
    return b.clock_answers.select("id", clock_seconds(q54).alias("asleep_seconds"), clock_seconds(q55).alias("awake_seconds"),
                                  sleep_hours(q54, q55).alias("sleep_hours"))
