"""Column resolution from schemas and feature-column selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import TARGETS

# Preferred value and timestamp column names, in order.
VALUE_NAMES = ["steps", "speed", "distance", "calories", "value", "count"]
WEEKLY_VALUE_NAMES = ["steps", "value", "count"]
TIMESTAMP_NAMES = ["start_timestamp", "start_time", "timestamp", "created_at", "start"]

# Columns that are never model features.
NON_FEATURES = {
    "app_user_id", "survey_response_id", "timestamp", "survey_timestamp", "survey_ts", "week_start", "time_key",
    "date", "phq9_response_id", "phq9_total_score", "window_hours",
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def value_column(df: DataFrame, weekly: bool = False) -> str | None:
    """The metric column, by name preference, else the first numeric one."""
    numeric = [c for c in numeric_columns(df) if c != "app_user_id"]
    for name in WEEKLY_VALUE_NAMES if weekly else VALUE_NAMES:
        if name in numeric:
            return name
    if not numeric and weekly:
        raise ValueError("no numeric column; name the value column")
    return numeric[0] if numeric else None


def timestamp_column(df: DataFrame, candidates: list[str] | None = None) -> str | None:
    """First candidate (then any text column) holding a parseable timestamp.

    Typed timestamp columns and text candidates are probed in one aggregate.
    """
    named = [c for c in (candidates or TIMESTAMP_NAMES) if c in df.columns]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in named]
    probe = named + text
    if not probe:
        return None
    counts = df.agg(*[F.count(F.col(c).try_cast("timestamp_ntz")).alias(c) for c in probe]).first()
    return next((c for c in probe if counts[c] > 0), None)


def label_columns() -> list[str]:
    return [label for label, _, _ in TARGETS.values()]


def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Everything that is not an id, a time or a label."""
    drop = NON_FEATURES | set(label_columns()) | set(exclude or [])
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if f.name not in drop and not isinstance(f.dataType, times)]


def split_by_type(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) among ``columns``."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    return numeric, [c for c in columns if c not in numeric]
