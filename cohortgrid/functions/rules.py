"""Survey scoring and risk rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AT_RISK, NOT_AT_RISK = "at_risk", "not_at_risk"

# Questionnaire item numbers.
YES_NO_ITEMS = [5, 8, 11, 12, 13, 15, 16, 17, 18]
SCALE_ITEMS = [2, 3, 7, 9, 21, 22, 23, 24, 25, 26, 27, 28, 31, 32, 33, 34, 35, 36, 37,
               40, 41, 42, 43, 44, 47, 48, 49, 50, 51, 52]
CLOCK_ITEMS = [54, 55]
SLEEP_QUALITY_ITEM = 56
DAILY_ITEMS = sorted(YES_NO_ITEMS + SCALE_ITEMS + CLOCK_ITEMS + [SLEEP_QUALITY_ITEM])
PHQ9_ITEMS = list(range(59, 68))

# Total name -> items summed.
TOTALS = {
    "positive_total": [21, 22, 37],
    "negative_total": [23, 24, 25, 26, 27, 28, 36],
    "social_stress_total": [31, 32, 33],
    "social_connection_total": [34, 35],
    "minority_total": [40, 41, 42, 43, 44],
    "emotion_regulation_total": [47, 48, 49, 50, 51, 52],
}

# Label -> (total, comparison, threshold at which the user is at risk).
THRESHOLDS = {
    "positive_emotion_label": ("positive_total", "<=", 5),
    "negative_emotion_label": ("negative_total", ">=", 14),
    "social_stress_label": ("social_stress_total", ">=", 6),
    "social_connection_label": ("social_connection_total", "<=", 4),
    "minority_stress_label": ("minority_total", ">=", 10),
    "emotion_regulation_label": ("emotion_regulation_total", ">=", 9),
}

# Modelling target -> (label column, positive class, negative class).
TARGETS = {
    "phq9": ("severity_label", "depressed", "not_depressed"),
    "suicide_risk": ("suicide_risk_label", AT_RISK, NOT_AT_RISK),
    "self_harm": ("self_harm_risk_label", AT_RISK, NOT_AT_RISK),
    "positive_emotion": ("positive_emotion_label", AT_RISK, NOT_AT_RISK),
    "negative_emotion": ("negative_emotion_label", AT_RISK, NOT_AT_RISK),
    "social_stress": ("social_stress_label", AT_RISK, NOT_AT_RISK),
    "social_connection": ("social_connection_label", AT_RISK, NOT_AT_RISK),
    "minority_stress": ("minority_stress_label", AT_RISK, NOT_AT_RISK),
    "emotion_regulation": ("emotion_regulation_label", AT_RISK, NOT_AT_RISK),
    "sleep": ("sleep_label", AT_RISK, NOT_AT_RISK),
}


def _any(tests: list[str]) -> Column:
    """OR in which a NULL answer counts as 'not met'."""
    return F.expr(" OR ".join(f"coalesce({t}, false)" for t in tests))


def risk(condition: Column) -> Column:
    return F.when(condition, AT_RISK).otherwise(NOT_AT_RISK)


def suicide_risk() -> Column:
    return risk(_any([f"q{i} >= 2" for i in (2, 3, 7)] + [f"q{i} = 1" for i in (5, 8, 12, 13)]))


def suicide_risk_five_item() -> Column:
    """The other published definition: four scale items and one yes/no item."""
    return risk(_any([f"q{i} >= 2" for i in (2, 3, 5, 7)] + ["q12 = 1"]))


def self_harm_risk() -> Column:
    return risk(_any(["q9 >= 2"] + [f"q{i} = 1" for i in (11, 15, 16, 17, 18)]))


def _sum_answered(items: list[int]) -> str:
    return " + ".join(f"coalesce(q{i}, 0)" for i in items)


def item_total(items: list[int]) -> Column:
    """Sum of answered items; NULL only when none was answered."""
    answered = ", ".join(f"q{i}" for i in items)
    return F.expr(f"CASE WHEN coalesce({answered}) IS NOT NULL THEN {_sum_answered(items)} END")


def threshold_label(label: str) -> Column:
    total, op, limit = THRESHOLDS[label]
    return F.when(F.col(total).isNotNull(), risk(F.expr(f"{total} {op} {limit}")))


def sleep_label(hours: Column, quality: Column) -> Column:
    known = hours.isNotNull() | quality.isNotNull()
    tests = [F.coalesce(t, F.lit(False)) for t in (hours <= 5, hours >= 11, quality <= 2)]
    return F.when(known, risk(tests[0] | tests[1] | tests[2]))


def phq9_total() -> Column:
    """Nine-item total; a missing item counts as 0."""
    return F.expr(_sum_answered(PHQ9_ITEMS))


def phq9_severity(total: Column) -> Column:
    return (
        F.when(total <= 4, "minimal")
        .when(total <= 9, "mild")
        .when(total <= 14, "moderate")
        .when(total <= 19, "moderately_severe")
        .otherwise("severe")
    )


def phq9_binary(total: Column) -> Column:
    return F.when(total < 10, "not_depressed").otherwise("depressed")
