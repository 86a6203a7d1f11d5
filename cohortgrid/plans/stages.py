"""Fit/transform stages for ``pyspark.ml`` pipelines and the task factory.

Stages take and return DataFrames and stay lazy; only ``fit`` of the
stages that learn something runs jobs. Side tables (labels, dimensions) are
constructor arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import feature_columns
from ..functions.rules import TARGETS
from ..functions.taxonomy import collapse_games, resolve_categories
from ..functions.timecols import add_seconds
from ..operators import align, fill, lookback, mlprep, surveys, timegrid
from ..session import materialize


def _param(name: str, doc: str, convert=None) -> Param:
    return Param(Params._dummy(), name, doc, convert or TypeConverters.identity)


class HealthGrid(Transformer):
    """Tagged metric events to the daily, hourly or weekly health table."""

    unit = _param("unit", "daily, hourly or weekly", TypeConverters.toString)
    weekAnchor = _param("weekAnchor", "first weekday of a week", TypeConverters.toString)
    fillMethod = _param("fillMethod", "fill method or empty", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, unit: str = "daily", weekAnchor: str = "MON", fillMethod: str = ""):
        super().__init__()
        self._setDefault(unit="daily", weekAnchor="MON", fillMethod="")
        self._set(**self._input_kwargs)

    def _transform(self, events: DataFrame) -> DataFrame:
        unit, anchor = self.getOrDefault("unit"), self.getOrDefault("weekAnchor")
        how = self.getOrDefault("fillMethod") or None
        if unit == "daily":
            return timegrid.daily_health(events, anchor, fill=how)
        if unit == "hourly":
            return timegrid.hourly_health(events, anchor, fill=how)
        if unit == "weekly":
            return timegrid.weekly_health(events, anchor)
        raise ValueError(f"unknown unit {unit!r}")


class ScreentimeGrid(Transformer):
    """App sessions to hourly screentime."""

    fillMethod = _param("fillMethod", "fill method or empty", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fillMethod: str = ""):
        super().__init__()
        self._setDefault(fillMethod="")
        self._set(**self._input_kwargs)

    def _transform(self, sessions: DataFrame) -> DataFrame:
        return timegrid.hourly_screentime(sessions, fill=self.getOrDefault("fillMethod") or None)


class WindowLabels(Transformer):
    """Hourly grid to one training row per (survey, window)."""

    target = _param("target", "modelling target", TypeConverters.toString)
    valueCol = _param("valueCol", "hourly value column", TypeConverters.toString)
    windows = _param("windows", "window lengths in hours", TypeConverters.toListInt)
    standardized = _param("standardized", "anchor windows at the reference hour", TypeConverters.toBoolean)
    propagate = _param("propagate", "propagate positive labels", TypeConverters.toBoolean)
    fillMethod = _param("fillMethod", "fill of empty slots", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labels: DataFrame | None = None, target: str = "suicide_risk", valueCol: str = "hourly_screentime",
                 windows: list[int] | None = None, standardized: bool = True, propagate: bool = False, fillMethod: str = "zero"):
        super().__init__()
        kwargs = dict(self._input_kwargs)
        self.labels = kwargs.pop("labels", None)
        kwargs["windows"] = kwargs.get("windows") or lookback.TRAINING_WINDOWS
        self._setDefault(target=target, valueCol=valueCol, standardized=standardized, propagate=propagate, fillMethod=fillMethod)
        self._set(**kwargs)

    def _transform(self, hourly: DataFrame) -> DataFrame:
        label, positive, _ = TARGETS[self.getOrDefault("target")]
        merged = lookback.multiwindow_slots(
            hourly, usable_labels(self.labels, label), self.getOrDefault("valueCol"), self.getOrDefault("windows"),
            self.getOrDefault("standardized"), fill=self.getOrDefault("fillMethod") or None, keep=[label],
        )
        if not self.getOrDefault("propagate"):
            return merged
        # Each window is its own training set, so labels spread within it.
        return surveys.propagate_positive(merged, label, positive, ["app_user_id", "window_hours"])


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """Labels of a target without NULL and ``N/A``, one per user-day."""
    return surveys.one_per_day(labels.where(F.col(label) != "N/A"), label)


class AppCategorizer(Estimator):
    """Learns the category of every app name once; the model only joins."""

    studyApp = _param("studyApp", "keyword naming the study's own app, or empty", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, dimension: DataFrame | None = None, studyApp: str = ""):
        super().__init__()
        self.dimension = self._input_kwargs.get("dimension")
        self._set(studyApp=self._input_kwargs.get("studyApp", ""))

    def _fit(self, sessions: DataFrame) -> AppCategories:
        names = sessions.select("app_name").where(F.col("app_name").isNotNull()).distinct()
        return AppCategories(materialize(
            resolve_categories(names, self.dimension, self.getOrDefault("studyApp") or None), "categories"))


class AppCategories(Model):
    """Fitted category table."""

    def __init__(self, table: DataFrame):
        super().__init__()
        self.table = table

    def _transform(self, sessions: DataFrame) -> DataFrame:
        return sessions.drop("app_category").join(self.table, "app_name", "left").withColumn(
            "app_category", collapse_games(F.col("app_category"))
        )


class SubwindowLabels(Transformer):
    """Categorised sessions to hour slots plus sub-window features per survey."""

    target = _param("target", "modelling target", TypeConverters.toString)
    lookbackHours = _param("lookbackHours", "hours before the survey", TypeConverters.toInt)
    subwindowHours = _param("subwindowHours", "hours per piece", TypeConverters.toInt)
    standardized = _param("standardized", "anchor windows at the reference hour", TypeConverters.toBoolean)
    propagate = _param("propagate", "propagate positive labels", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, labels: DataFrame | None = None, target: str = "suicide_risk", lookbackHours: int = 12,
                 subwindowHours: int = 3, standardized: bool = True, propagate: bool = False):
        super().__init__()
        kwargs = dict(self._input_kwargs)
        self.labels = kwargs.pop("labels", None)
        self._setDefault(target=target, lookbackHours=lookbackHours, subwindowHours=subwindowHours,
                         standardized=standardized, propagate=propagate)
        self._set(**kwargs)

    def _transform(self, sessions: DataFrame) -> DataFrame:
        label, positive, _ = TARGETS[self.getOrDefault("target")]
        hours, standardized = self.getOrDefault("lookbackHours"), self.getOrDefault("standardized")
        rows = usable_labels(self.labels, label)
        timed = sessions.withColumn("total_time_seconds", F.col("total_time_minutes") * 60)
        if "calculated_start_time" not in timed.columns:
            start = add_seconds(F.col("last_time_used"), -F.col("total_time_seconds"))
            timed = timed.withColumn("calculated_start_time", start)
        hourly = timegrid.hourly_screentime(timed)
        slots = lookback.lookback_slots(hourly, rows, "hourly_screentime", hours, standardized, keep=[label])
        pieces = lookback.subwindow_features(sessions, rows, hours, self.getOrDefault("subwindowHours"), standardized)
        merged = align.join_features(slots, pieces)
        return surveys.propagate_positive(merged, label, positive) if self.getOrDefault("propagate") else merged


class FeatureSelector(Estimator):
    """Learns the feature columns from the first frame it sees."""

    exclude = _param("exclude", "further columns to leave out", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, exclude: list[str] | None = None):
        super().__init__()
        self._set(exclude=self._input_kwargs.get("exclude") or [])

    def _fit(self, df: DataFrame) -> SelectedFeatures:
        return SelectedFeatures(feature_columns(df, self.getOrDefault("exclude")))


class SelectedFeatures(Model):
    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)


class LabelEncoder(Transformer):
    """Adds the binary ``label`` of a target."""

    target = _param("target", "modelling target", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, target: str = "suicide_risk"):
        super().__init__()
        self._set(target=self._input_kwargs.get("target", "suicide_risk"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return mlprep.encode_label(df, self.getOrDefault("target"))


class MissingValues(Estimator):
    """Learns fill values for zero, mean or median; other strategies learn nothing."""

    strategy = _param("strategy", "missing-value strategy", TypeConverters.toString)
    columns = _param("columns", "columns to fill", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, strategy: str = "zero", columns: list[str] | None = None, keys: list[str] | None = None,
                 order: str | None = None):
        super().__init__()
        kwargs = self._input_kwargs
        self.keys, self.order = kwargs.get("keys"), kwargs.get("order")
        self._set(strategy=kwargs.get("strategy", "zero"), columns=kwargs.get("columns") or [])

    def _fit(self, df: DataFrame) -> FilledValues:
        names, how = self.getOrDefault("columns"), self.getOrDefault("strategy")
        return FilledValues(names, how, fill.fit_imputer(df, names, how), self.keys, self.order)


class FilledValues(Model):
    def __init__(self, columns: list[str], strategy: str, fitted: dict[str, float], keys, order):
        super().__init__()
        self.columns, self.strategy, self.fitted, self.keys, self.order = columns, strategy, fitted, keys, order

    def _transform(self, df: DataFrame) -> DataFrame:
        return fill.impute(df, self.columns, self.strategy, self.keys, self.order, self.fitted)


class DataValidator(Estimator):
    """Checks a training frame; the model passes rows through and keeps ``report``."""

    labelCol = _param("labelCol", "label column", TypeConverters.toString)
    minSamples = _param("minSamples", "least rows", TypeConverters.toInt)
    minFeatures = _param("minFeatures", "least columns", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", minSamples: int = 10, minFeatures: int = 1):
        super().__init__()
        self._setDefault(labelCol=labelCol, minSamples=minSamples, minFeatures=minFeatures)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ValidatedData:
        get = self.getOrDefault
        report = mlprep.validation_report(df, get("labelCol"), get("minSamples"), get("minFeatures")).first().asDict()
        return ValidatedData(report)


class ValidatedData(Model):
    def __init__(self, report: dict):
        super().__init__()
        self.report = report
        self.valid = not (report["too_few_rows"] or report["too_few_columns"] or report["single_class"])

    def _transform(self, df: DataFrame) -> DataFrame:
        return df


class WeeklyLabels(Transformer):
    """Weekly health table joined with weekly labels."""

    @keyword_only
    def __init__(self, *, labels: DataFrame | None = None):
        super().__init__()
        self.labels = self._input_kwargs.get("labels")

    def _transform(self, weekly: DataFrame) -> DataFrame:
        return align.join_weekly([weekly], surveys.weekly_first(self.labels))


def screentime_task(target: str, labels: DataFrame, **options) -> Pipeline:
    """App sessions to a multi-window training table of a target."""
    return Pipeline(stages=[ScreentimeGrid(), WindowLabels(labels=labels, target=target, **options)])


def steps_task(target: str, labels: DataFrame, **options) -> Pipeline:
    """Metric events to a multi-window step training table."""
    return Pipeline(stages=[HealthGrid(unit="hourly"), WindowLabels(labels=labels, target=target, valueCol="hourly_steps", **options)])


def weekly_task(labels: DataFrame) -> Pipeline:
    return Pipeline(stages=[HealthGrid(unit="weekly"), WeeklyLabels(labels=labels)])


def subwindow_task(target: str, labels: DataFrame, dimension: DataFrame | None = None, **options) -> Pipeline:
    """Raw categorisable sessions to combined features; names are categorised once, in ``fit``."""
    return Pipeline(stages=[AppCategorizer(dimension=dimension), SubwindowLabels(labels=labels, target=target, **options)])


TASKS: dict[str, Callable[..., Pipeline]] = {
    f"screentime_{target}": (lambda labels, _t=target, **options: screentime_task(_t, labels, **options)) for target in TARGETS
}
TASKS["health_weekly"] = lambda labels, **options: weekly_task(labels)


def build_task(task: str, labels: DataFrame, **options) -> Pipeline:
    """The pipeline of a named task."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; use one of {sorted(TASKS)}")
    return TASKS[task](labels, **options)
