"""Aligning behaviour tables with survey labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import keep_first


def join_weekly(metrics: list[DataFrame], labels: DataFrame) -> DataFrame:
    """Inner join of weekly metric tables and weekly labels on (user, week)."""
    return reduce(lambda a, b: a.join(b, ["app_user_id", "week_start"]), [*metrics, labels])


def join_week_label(grid: DataFrame, labels: DataFrame) -> DataFrame:
    """Each grid row with its week's label."""
    return grid.join(labels, ["app_user_id", "week_start"])


def next_survey(grid: DataFrame, surveys: DataFrame, ts: str = "datetime", survey_ts: str = "survey_ts",
                survey_key: str = "survey_response_id", carry: list[str] | None = None) -> DataFrame:
    """Forward as-of join: each row takes the user's earliest survey at or after it.

    Rows without a later survey are dropped. Rows and surveys are ordered
    inside each (user, day); a summary with one survey per (user, day) is
    scanned backwards to give every day the first survey of a later day. A
    user's rows are thus spread over as many tasks as the user has days.
    """
    carry = carry or [c for c in surveys.columns if c not in ("app_user_id", survey_ts, survey_key)]
    payload = F.struct(F.col(survey_ts), F.col(survey_key), *carry)
    right = surveys.where(F.col(survey_ts).isNotNull()).select(
        "app_user_id", F.to_date(survey_ts).alias("_day"), F.col(survey_ts).alias("_t"), payload.alias("_s")
    )
    left = grid.select("app_user_id", F.to_date(ts).alias("_day"), F.col(ts).alias("_t"), F.struct(*grid.columns).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    # Latest first, surveys before rows of the same instant: the frame only grows.
    latest_first = [
        F.col("_t").desc(), F.col("_s").isNull(), F.col(f"_s.{survey_key}").desc(),
    ]
    in_day = (
        Window.partitionBy("app_user_id", "_day").orderBy(*latest_first).rowsBetween(Window.unboundedPreceding, 0)
    )
    days = both.select("app_user_id", "_day", "_s").groupBy("app_user_id", "_day").agg(F.min("_s").alias("_day_first"))
    later = Window.partitionBy("app_user_id").orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("app_user_id", "_day", F.last("_day_first", ignorenulls=True).over(later).alias("_later"))
    found = both.join(carried, ["app_user_id", "_day"]).withColumn(
        "_hit", F.coalesce(F.last("_s", ignorenulls=True).over(in_day), F.col("_later"))
    )
    found = found.where(F.col("_row").isNotNull() & F.col("_hit").isNotNull())
    return found.select("_row.*", "_hit.*")


def join_features(slots: DataFrame, subwindows: DataFrame, by_user_if_empty: bool = False) -> DataFrame:
    """Hour-slot and sub-window features of the same survey.

    ``by_user_if_empty`` retries on the user alone when no survey matches;
    it costs one probe and can fan out, so it is off by default.
    """
    repeated = [c for c in subwindows.columns if c in slots.columns and c not in ("app_user_id", "survey_response_id")]
    right = subwindows.drop(*repeated)
    joined = slots.join(right, ["app_user_id", "survey_response_id"])
    if by_user_if_empty and joined.isEmpty():
        joined = slots.join(right.drop("survey_response_id"), "app_user_id")
    return joined


def join_same_day(daily: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Daily rows with the same day's label; ``N/A`` labels are dropped."""
    rows = labels.where(F.col(label) != "N/A").withColumn("date", F.to_date("survey_ts"))
    return daily.join(rows, ["app_user_id", "date"])


def require_two_classes(df: DataFrame, label: str) -> DataFrame:
    classes = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if classes["lo"] == classes["hi"]:
        raise ValueError(f"{label} has fewer than two classes")
    return df


def map_participants(df: DataFrame, mapping: DataFrame, source: str = "app_user_id", target: str = "participant_id") -> DataFrame:
    """Replace the user id by its study id; unmapped ids stay. The last mapping row of a user wins."""
    order = F.struct(*[c for c in ("row_id", target) if c in mapping.columns])
    last = mapping.groupBy(source).agg(F.max_by(target, order).alias("_mapped"))
    joined = df.join(last, source, "left")
    mapped: Column = F.coalesce(F.col("_mapped"), F.col(source).cast("string"))
    return joined.withColumn(source, mapped).drop("_mapped")


def first_of_day(df: DataFrame, ts: str, key: str) -> DataFrame:
    """Keep the first merged row of each (user, day)."""
    rows = df.withColumn("_date", F.to_date(ts))
    return keep_first(rows, ["app_user_id", "_date"], [F.col(ts), F.col(key)]).drop("_date")
