"""Experiments over targets, windows, splits and models: one row of counts and metrics for each combination.

All experiments are one table. A training row is repeated for the targets it has a label of and for the split modes,
with its features as one array, so an experiment is a filter, never a table of its own: strata, users and first labels
are counted within (target, window) by keys that hold both. The logistic models of all experiments are solved together
(``newton.fit_keyed``); forests and boosted trees are one distributed fit for each, a few at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from . import metrics, mlprep, models, newton

BASELINE = "baseline"
SPLITS = ("stratified", "by_user", "temporal")
KEYS = ["target", "window_hours", "split_mode"]
COUNTS = "target string, window_hours int, split_mode string, model string, n_train long, n_test long, tp long, fp long, fn long, tn long"


def stacked(training: DataFrame, targets: dict[str, tuple[str, str]], features: Callable[[int], list[str]], windows: Iterable[int],
            key: str, ts: str = "ref_ts", user: str = "app_user_id") -> DataFrame:
    """``(target, window_hours, key, user, ts, label, x)``: a row of the long multi-window table for each target whose
    label it has. ``targets`` gives a target's column and positive class; ``N/A`` counts as no label."""
    labels = F.array(*[F.struct(F.lit(name).alias("target"), F.when(F.col(column) != "N/A", (F.col(column) == positive).cast("double")).alias("label"))
                       for name, (column, positive) in targets.items()])
    x: Column = F.lit(None).cast("array<double>")
    for w in windows:
        x = F.when(F.col("window_hours") == w, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features(w)])).otherwise(x)
    long = training.where(F.col("window_hours").isin(*windows)).select(
        F.explode(labels).alias("t"), F.col("window_hours").cast("int").alias("window_hours"), key, F.col(user).alias("user"), F.col(ts).alias("ts"), x.alias("x"))
    return long.select("t.target", "window_hours", key, "user", "ts", "t.label", "x").where("label IS NOT NULL")


def split_all(rows: DataFrame, key: str, modes: Iterable[str] = SPLITS, test_size: float = 0.3) -> DataFrame:
    """The stacked rows once for each split mode, with ``split_mode`` and ``is_test``."""
    def within(*more: str) -> Column:
        return F.concat_ws("|", "target", "window_hours", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in more])

    made = []
    for mode in modes:
        if mode == "stratified":
            out = mlprep.split_stratified(rows.withColumn("_stratum", within("label")), key, "_stratum", test_size).drop("_stratum")
        elif mode == "by_user":
            out = mlprep.split_by_user(rows.withColumn("app_user_id", within("user")), key, "label", test_size).drop("app_user_id")
        elif mode == "temporal":
            out = mlprep.split_temporal(rows.withColumn("app_user_id", within("user")), key, "ts", test_size).drop("app_user_id")
        else:
            raise ValueError(f"unknown split mode {mode!r}; use {', '.join(SPLITS)}")
        made.append(out.select(*rows.columns, F.lit(mode).alias("split_mode"), "is_test"))
    return reduce(DataFrame.unionByName, made)


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
                                   F.count_distinct(F.when(~F.col("is_test"), F.col("label"))).alias("classes"), F.max(F.size("x")).alias("width")).where("n_test > 0")


def _baseline(rows: DataFrame, key: str) -> DataFrame:
    """Each user's first label, for the user's test rows."""
    own = [*KEYS, "_user"]
    rows = rows.withColumn("_user", F.coalesce(F.col("user").cast("string"), F.lit("")))
    first = rows.groupBy(*own).agg(F.min_by("label", F.struct("ts", key)).alias("y_pred"))
    return rows.where("is_test").join(first, own).select(*KEYS, F.col("label").alias("y_true"), "y_pred")


def _joint(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Scores of the logistic models of all experiments in ``open_``."""
    named = rows.join(open_.select(*KEYS), KEYS).select("is_test", "label", "x", F.concat_ws("/", *KEYS).alias("k"))
    named = materialize(named.hint("rebalance"), "experiment-rows")
    fitted = newton.fit_keyed(named.where(~F.col("is_test")).select("k", "label", "x"))
    scored = materialize(newton.score_keyed(named.where("is_test").select("k", "label", "x"), fitted, []), "experiment-scores")
    release(named)
    part = F.split("k", "/")
    return scored.select(part[0].alias("target"), part[1].cast("int").alias("window_hours"), part[2].alias("split_mode"), "y_true", "y_pred")


def _one_by_one(rows: DataFrame, key: str, name: str, open_: DataFrame, parallelism: int, keep: Callable[[list[tuple]], None], **params) -> None:
    def run(one) -> None:
        own = rows.where((F.col("target") == one.target) & (F.col("window_hours") == one.window_hours) & (F.col("split_mode") == one.split_mode))
        own = own.select(key, "is_test", "label", array_to_vector("x").alias("features"))
        size = models.FOREST_BYTES if name == "rf" else models.TASK_BYTES
        train = models.dealt(mlprep.with_class_weight(own.where(~F.col("is_test"))), one.width, key, size).persist()
        if name == "gbt":
            models.checkpointed(rows.sparkSession)
        try:
            model = models.make_model(name, **params).fit(train)
        finally:
            train.unpersist()
        scored = model.transform(own.where("is_test")).select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
        hit = metrics.confusion(scored, []).first()
        keep([(one.target, one.window_hours, one.split_mode, name, one.n_train, one.n_test, hit.tp, hit.fp, hit.fn, hit.tn)])

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(inheritable_thread_target(rows.sparkSession)(run), open_.collect()))


def run_experiments(rows: DataFrame, key: str, names: tuple[str, ...] = ("lr", "rf"), splits: tuple[str, ...] = SPLITS, baseline: bool = True,
                    parallelism: int = 8, path: str | None = None, **params) -> DataFrame:
    """Train and score every model on every experiment of the stacked ``rows``, with the persistence baseline.

    An experiment whose training rows lack a class has no row for its models; one without test rows has none at all.
    With ``path``, rows are appended there as they are found, and those that are there already are not run again.
    ``params`` go to the models that are fitted one by one. The driver sees four counts for each row."""
    spark = rows.sparkSession
    rows = materialize(rows, "stacked")
    table = materialize(split_all(rows, key, splits), "experiments")
    release(rows)
    sizes = materialize(_sizes(table), "experiment-sizes")
    try:
        found = [tuple(r) for r in spark.read.schema(COUNTS).parquet(path).collect()] if path else []
    except AnalysisException:  # nothing is there yet
        found = []
    known = {r[:4] for r in found}

    one_at_a_time = Lock()  # writers to one folder share its folder of unfinished files

    def keep(new: list[tuple]) -> None:
        with one_at_a_time:
            found.extend(new)
            if path and new:
                spark.createDataFrame(new, COUNTS).coalesce(1).write.mode("append").parquet(path)

    def left(name: str) -> DataFrame:
        some = [k[:3] for k in known if k[3] == name]
        if not some:
            return sizes
        return sizes.join(spark.createDataFrame(some, "target string, window_hours int, split_mode string"), KEYS, "left_anti")

    def counted(scored: DataFrame, name: str, open_: DataFrame) -> list[tuple]:
        hits = metrics.confusion(scored, KEYS).join(open_, KEYS)
        return [tuple(r) for r in hits.select(*KEYS, F.lit(name), "n_train", "n_test", "tp", "fp", "fn", "tn").collect()]

    if baseline:
        keep(counted(_baseline(table, key), BASELINE, left(BASELINE)))
    for name in names:
        open_ = left(name).where("classes > 1")
        if name == "lr":
            if open_.take(1):
                keep(counted(_joint(table, open_), name, open_))
        else:
            _one_by_one(table, key, name, open_, parallelism, keep, **params)
    for t in (table, sizes):
        release(t)
    return metrics.classification_metrics(spark.createDataFrame(found, COUNTS))


def comparison(results: DataFrame, metric: str = "f1") -> DataFrame:
    """All rows, best first within each target, with their place."""
    order = ["window_hours", "split_mode", "model"]
    return metrics.best_rows(results.withColumn("_m", F.round(metric, 9)), ["target"], "_m", order, 1_000_000, "place").drop("_m")


def best_of(results: DataFrame, criteria: Iterable[str] = ("f1", "balanced_accuracy", "recall", "accuracy")) -> DataFrame:
    """The best trained row of each target by each criterion."""
    names = list(criteria)
    cells = ", ".join(f"'{m}', round({m}, 9)" for m in names)
    long = results.where(F.col("model") != BASELINE).select(*KEYS, "model", F.expr(f"stack({len(names)}, {cells}) as (criterion, value)"))
    return metrics.best_rows(long, ["target", "criterion"], "value", ["window_hours", "split_mode", "model"])
