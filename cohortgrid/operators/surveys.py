"""Survey answers: long-to-wide, scoring, daily label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.parse import majority_yes, safe_int, sleep_hours, yes_no
from ..functions.timecols import lenient_timestamp, week_start
from .clean import keep_first

MORNING, AFTERNOON, WEEKLY = 0, 1, 2


def pivot_answers(responses: DataFrame, answers: DataFrame, items: list[int], survey_ids: list[int] | None) -> DataFrame:
    """One row per response with text columns ``q<item>``; repeats keep the largest text.

    Filters sit below the join, and the aggregation reuses the join's
    partitioning on the response id.
    """
    chosen = responses.select(F.col("id").alias("survey_response_id"), "app_user_id", "survey_id", "survey_ts")
    if survey_ids is not None:
        chosen = chosen.where(F.col("survey_id").isin(survey_ids))
    wanted = answers.select("survey_response_id", "question_id", "answer").where(F.col("question_id").isin(items))
    return (
        chosen.join(wanted, "survey_response_id")
        .groupBy("survey_response_id", "app_user_id", "survey_ts")
        .agg(
            F.max("survey_id").alias("survey_id"),
            *[F.expr(f"max(CASE WHEN question_id = {i} THEN answer END) AS q{i}") for i in items],
        )
    )


def coerce_answers(wide: DataFrame) -> DataFrame:
    """Typed daily answers; rows without a usable timestamp are dropped."""
    numeric = [i for i in rules.SCALE_ITEMS + [rules.SLEEP_QUALITY_ITEM] if f"q{i}" in wide.columns]
    flags = [i for i in rules.YES_NO_ITEMS if f"q{i}" in wide.columns]
    typed = wide.withColumns(
        {f"q{i}": safe_int(f"q{i}") for i in numeric}
        | {f"q{i}": yes_no(f"q{i}") for i in flags}
        | {"survey_ts": lenient_timestamp(F.col("survey_ts"))}
    )
    return typed.where(F.col("survey_ts").isNotNull()).withColumn("survey_date", F.to_date("survey_ts"))


def average_by_day(typed: DataFrame) -> DataFrame:
    """One row per (user, day): mean items, first response id, morning sleep answers.

    The morning row is picked by the same aggregation that averages the
    items, so the day needs a single shuffle and no join.
    """
    order = F.struct("survey_ts", "survey_response_id")
    sleep = [f"q{i}" for i in rules.CLOCK_ITEMS + [rules.SLEEP_QUALITY_ITEM]]
    morning = F.when(F.col("survey_id") == MORNING, F.struct(order.alias("o"), *sleep))
    days = typed.groupBy("app_user_id", "survey_date").agg(
        F.min(order).alias("_first"),
        F.min(morning).alias("_morning"),
        *[F.expr(f"avg(q{i}) AS q{i}") for i in sorted(rules.SCALE_ITEMS + rules.YES_NO_ITEMS)],
    )
    days = days.withColumns({f"q{i}": majority_yes(F.col(f"q{i}")) for i in rules.YES_NO_ITEMS})
    return days.withColumns(
        {"survey_response_id": F.col("_first.survey_response_id"), "survey_ts": F.col("_first.survey_ts")}
        | {c: F.col(f"_morning.{c}") for c in sleep}
    ).drop("_first", "_morning")


def add_totals(typed: DataFrame) -> DataFrame:
    return typed.withColumns({name: rules.item_total(items) for name, items in rules.TOTALS.items()})


def add_labels(scored: DataFrame, averaged: bool = False) -> DataFrame:
    """All nine daily risk labels."""
    out = scored.withColumn("sleep_hours", sleep_hours(F.col("q54"), F.col("q55")))
    sleep = rules.sleep_label(F.col("sleep_hours"), F.col("q56"))
    if not averaged:
        sleep = F.when(F.col("survey_id") == MORNING, sleep).otherwise("N/A")
    labels = {name: rules.threshold_label(name) for name in rules.THRESHOLDS}
    return out.withColumns(
        {
            "suicide_risk_label": rules.suicide_risk(),
            "self_harm_risk_label": rules.self_harm_risk(),
            "sleep_label": sleep,
        }
        | labels
    )


def daily_labels(responses: DataFrame, answers: DataFrame, averaged: bool = False) -> DataFrame:
    """Answers, totals and risk labels per daily survey, or per user-day when ``averaged``."""
    typed = coerce_answers(pivot_answers(responses, answers, rules.DAILY_ITEMS, [MORNING, AFTERNOON]))
    if averaged:
        typed = average_by_day(typed)
    return add_labels(add_totals(typed), averaged)


def five_item_labels(responses: DataFrame, answers: DataFrame) -> DataFrame:
    """Suicide-risk labels under the five-item definition."""
    items = [2, 3, 5, 7, 12]
    wide = pivot_answers(responses, answers, items, [MORNING, AFTERNOON])
    yes_no_items = {12}
    typed = wide.withColumns(
        {f"q{i}": yes_no(f"q{i}") if i in yes_no_items else safe_int(f"q{i}") for i in items}
    )
    return typed.withColumn("suicide_risk_label", rules.suicide_risk_five_item())


def phq9_scores(responses: DataFrame, answers: DataFrame, survey_ids: list[int] | None = None) -> DataFrame:
    """PHQ-9 totals with the five-level and binary severity labels."""
    wide = pivot_answers(responses, answers, rules.PHQ9_ITEMS, survey_ids)
    typed = wide.withColumns({f"q{i}": safe_int(f"q{i}") for i in rules.PHQ9_ITEMS})
    total = typed.withColumn("phq9_total_score", rules.phq9_total())
    return total.withColumns(
        {
            "severity_level": rules.phq9_severity(F.col("phq9_total_score")),
            "severity_label": rules.phq9_binary(F.col("phq9_total_score")),
        }
    )


def weekly_first(phq9: DataFrame, week_anchor: str = "MON") -> DataFrame:
    """First scored response per (user, week)."""
    rows = phq9.where(F.col("survey_ts").isNotNull()).withColumn(
        "week_start", week_start(F.to_date("survey_ts"), week_anchor)
    )
    first = keep_first(rows, ["app_user_id", "week_start"], [F.col("survey_ts"), F.col("survey_response_id")])
    return first.select("app_user_id", "week_start", "severity_label", "phq9_total_score")


def labels_for_target(target: str, daily: DataFrame | None = None, phq9: DataFrame | None = None) -> DataFrame:
    """The label table of a modelling target."""
    if target not in rules.TARGETS:
        raise ValueError(f"unknown target {target!r}; use one of {sorted(rules.TARGETS)}")
    label = rules.TARGETS[target][0]
    source = phq9 if target == "phq9" else daily
    keep = ["survey_response_id", "app_user_id", "survey_ts", label]
    if "survey_id" in source.columns:
        keep.insert(2, "survey_id")
    return source.select(*keep)


def one_per_day(labels: DataFrame, label: str) -> DataFrame:
    """One survey per (user, day): the morning survey for sleep, else the day's first.

    Rows with a NULL label are dropped first.
    """
    rows = labels.where(F.col(label).isNotNull()).withColumn("_date", F.to_date("survey_ts"))
    if label == "sleep_label" and "survey_id" in labels.columns:
        rows = rows.where(F.col("survey_id") == MORNING)
    order = [F.col("survey_ts"), F.col("survey_response_id")]
    return keep_first(rows, ["app_user_id", "_date"], order).drop("_date")


def propagate_positive(labels: DataFrame, label: str, positive: str, keys: list[str] | None = None) -> DataFrame:
    """Users with one positive row are positive on every row (within ``keys``).

    The positive users are aggregated first (combined on the map side) and
    joined back, so a user's rows are never gathered in one task.
    """
    keys = keys or ["app_user_id"]
    positives = labels.where(F.col(label) == positive).select(*keys).distinct()
    flagged = labels.join(positives.withColumn("_positive", F.lit(True)), keys, "left")
    return flagged.withColumn(label, F.when(F.col("_positive"), positive).otherwise(F.col(label))).drop("_positive")


def propagation_summary(labels: DataFrame, label: str, positive: str) -> DataFrame:
    """Users and rows positive before and after propagation."""
    hit = F.count_if(F.col(label) == positive)
    per_user = labels.groupBy("app_user_id").agg(F.count(F.lit(1)).alias("n"), hit.alias("p"))
    return per_user.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("p") > 0).alias("positive_users"),
        F.sum("p").alias("positive_rows_before"),
        F.sum(F.when(F.col("p") > 0, F.col("n")).otherwise(0)).alias("positive_rows_after"),
    )


def first_label_baseline(labels: DataFrame, label: str) -> DataFrame:
    """Predict each user's earliest label for all of the user's rows."""
    first = labels.groupBy("app_user_id").agg(
        F.min_by(label, F.struct("survey_ts", "survey_response_id")).alias("predicted")
    )
    return labels.join(first, "app_user_id")
