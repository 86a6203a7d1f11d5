"""Logical study tables as views over the benchmark tables.

Each binding is one SELECT. Texts with ``{table}`` placeholders run on Spark
through ``spark.sql(text, table=df)``; the oracle uses the same text, or the
second text where dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Position -> question id used to spread line items over the daily questions.
QUESTION_ORDER = [2, 3, 5, 7, 8, 12, 13, 9, 11, 15, 16, 17, 18, 21, 22, 37, 23, 24, 25, 26, 27, 28, 36,
                  31, 32, 33, 34, 35, 40, 41, 42, 43, 44, 47, 48, 49, 50, 51, 52, 54, 55, 56]

# Leading bytes of the payload containers, in hex.
SIGNATURES = ["000000186674797033677034", "0000001C667479704D344120", "63616666", "FFF1",
              "52494646000000005741564545", "494433", "2321414D52", "00"]

_QUESTIONS = ", ".join(f"({i}, {q})" for i, q in enumerate(QUESTION_ORDER))
_SPARK_SIGS = "array(" + ", ".join(f"'{s}'" for s in SIGNATURES) + ")"
_DUCK_SIGS = "[" + ", ".join(f"'{s}'" for s in SIGNATURES) + "]"

# name -> (tables used, text for both engines) or (tables used, Spark text, DuckDB text)
VIEWS: dict[str, tuple] = {
    "metric_events": (["events"], """
        SELECT event_id AS id, user_id AS app_user_id,
               CASE event_type WHEN 'view' THEN 'steps' WHEN 'click' THEN 'speed'
                    WHEN 'signup' THEN 'distance' ELSE 'calories' END AS metric,
               value, ts AS start_timestamp
        FROM {events} WHERE event_type <> 'error'"""),
    "surveys": (["events"], """
        SELECT event_id AS survey_response_id, user_id AS app_user_id,
               CAST(event_id % 2 AS INT) AS survey_id, ts AS survey_ts,
               CASE WHEN value < 20 THEN 'at_risk' ELSE 'not_at_risk' END AS risk_label
        FROM {events} WHERE event_type = 'error'"""),
    "category_sessions": (["events", "part"], """
        SELECT e.event_id AS screentime_id, e.user_id AS app_user_id, p.p_name AS app_name,
               p.p_type AS app_category, e.value AS total_time_minutes, e.ts AS last_time_used
        FROM {events} e JOIN {part} p ON p.p_partkey = e.event_id % (SELECT count(*) FROM {part})
        WHERE e.event_type <> 'error'"""),
    "survey_response": (["orders"], """
        SELECT o_orderkey AS id, o_custkey AS app_user_id,
               CAST(o_orderkey % 3 AS INT) AS survey_id, o_orderdate AS survey_ts FROM {orders}"""),
    "answer": (["lineitem"], """
        SELECT l_orderkey AS survey_response_id,
               59 + ((l_suppkey + l_linenumber) % 9) AS question_id,
               CAST(CAST(l_quantity AS INT) % 4 AS STRING) AS answer
        FROM {lineitem}"""),
    "daily_answer": (["lineitem"], f"""
        SELECT l.l_orderkey AS survey_response_id, m.qid AS question_id,
               CASE WHEN m.qid IN (5, 8, 11, 12, 13, 15, 16, 17, 18)
                    THEN CASE WHEN l.l_quantity < 5 THEN 'yes' ELSE 'no' END
                    WHEN m.qid IN (54, 55)
                    THEN concat(lpad(CAST(CAST(l.l_quantity AS INT) % 24 AS STRING), 2, '0'), ':30')
                    ELSE CAST(CAST(l.l_quantity AS INT) % 5 AS STRING) END AS answer
        FROM {{lineitem}} l JOIN (VALUES {_QUESTIONS}) AS m(idx, qid)
          ON m.idx = (l.l_suppkey * 7 + l.l_partkey + l.l_linenumber) % 42"""),
    "participant_map": (["customer"], "SELECT c_custkey AS app_user_id, c_name AS participant_id FROM {customer}"),
    "scored": (["events"], """
        SELECT event_id AS id, user_id AS app_user_id, event_type AS model,
               CASE WHEN value > 30 THEN 1 ELSE 0 END AS y_true,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS score
        FROM {events}"""),
    "screentime": (["orders"], """
        SELECT o_orderkey AS id, o_custkey AS app_user_id, o_orderdate AS start_time,
               timestampadd(SECOND, CAST(floor(o_totalprice) AS INT), o_orderdate) AS end_time FROM {orders}""", """
        SELECT o_orderkey AS id, o_custkey AS app_user_id, o_orderdate AS start_time,
               o_orderdate + to_seconds(CAST(floor(o_totalprice) AS INT)) AS end_time FROM {orders}"""),
    "screentime_app": (["lineitem", "part"], """
        SELECT l_orderkey AS screentime_id, l_linenumber AS line, p_name AS app_name, p_type AS app_category,
               CAST(l_quantity * 60000 AS BIGINT) AS total_time_ms,
               timestampadd(HOUR, CAST(l_partkey % 24 AS INT), l_shipdate) AS last_time_used
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""", """
        SELECT l_orderkey AS screentime_id, l_linenumber AS line, p_name AS app_name, p_type AS app_category,
               CAST(l_quantity * 60000 AS BIGINT) AS total_time_ms,
               l_shipdate + to_hours(CAST(l_partkey % 24 AS INT)) AS last_time_used
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""),
    "clock_answers": (["events"], """
        SELECT event_id AS id,
               CASE event_id % 3 WHEN 0 THEN date_format(ts, 'hh:mm a') WHEN 1 THEN date_format(ts, 'HH:mm')
                    ELSE date_format(ts, 'HH:mm:ss') END AS q54,
               date_format(ts + make_dt_interval(0, CAST(event_id % 12 AS INT)), 'hh:mma') AS q55
        FROM {events}""", """
        SELECT event_id AS id,
               CASE event_id % 3 WHEN 0 THEN strftime(ts, '%I:%M %p') WHEN 1 THEN strftime(ts, '%H:%M')
                    ELSE strftime(ts, '%H:%M:%S') END AS q54,
               strftime(ts + to_hours(CAST(event_id % 12 AS INT)), '%I:%M%p') AS q55
        FROM {events}"""),
    "payloads": (["documents"], f"""
        SELECT doc_id AS id, doc_id % 100 AS survey_response_id, doc_id % 5 AS audio_question_id,
               CASE WHEN doc_id % 3 > 0 THEN timestampadd(HOUR, CAST(doc_id % 700 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00') END AS ts,
               CASE WHEN doc_id % 2 > 0 THEN timestampadd(HOUR, CAST(doc_id % 600 AS INT), TIMESTAMP_NTZ '2024-02-01 00:00:00') END AS created_at,
               concat(unhex(element_at({_SPARK_SIGS}, CAST(doc_id % 8 AS INT) + 1)), encode(text, 'UTF-8')) AS payload
        FROM {{documents}}""", f"""
        SELECT doc_id AS id, doc_id % 100 AS survey_response_id, doc_id % 5 AS audio_question_id,
               CASE WHEN doc_id % 3 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 700 AS INT)) END AS ts,
               CASE WHEN doc_id % 2 > 0 THEN TIMESTAMP '2024-02-01 00:00:00' + to_hours(CAST(doc_id % 600 AS INT)) END AS created_at,
               unhex(list_extract({_DUCK_SIGS}, CAST(doc_id % 8 AS INT) + 1)) || encode(text) AS payload
        FROM {{documents}}"""),
}


class Bound:
    """The study tables of one data folder: ``bound.surveys`` and so on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._raw: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        if table not in self._raw:
            self._raw[table] = self.spark.read.parquet(f"{self.root}/{table}.parquet")
        return self._raw[table]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        tables, text = VIEWS[name][:2]
        view = self.spark.sql(text, **{t: self.raw(t) for t in tables})
        setattr(self, name, view)
        return view


def duck_text(name: str) -> str:
    """A binding as DuckDB SQL over the registered views."""
    spec = VIEWS[name]
    return spec[-1].format(**{t: t for t in spec[0]})
