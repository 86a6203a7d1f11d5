"""Learning-data preparation, splits, metrics and models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.timecols import lenient_timestamp
from ..operators import clean, experiments, lookback, metrics, mlprep, models, surveys, sweep, timegrid
from ..session import materialize, release
from .align_queries import (
    _OWN_TIME, MULTI_SLOTS, COMBINED, COMBINED_VIEWS, COUNTS, HOURS, LABEL, LOOKBACK, METRIC_OUT, ONE_PER_DAY, SIZE, STD_PARTS, STD_SLOTS,
    SURVEYS, SWEEP_PARTS, TEMPORAL, TEMPORAL_SPLIT, combined_of, hourly_of, metric_parts, one_per_day_of, slot_columns, slot_sql, standard_slots, training_of,
)
from .grid_queries import APP_PARTS, EVENTS, GRID_PARTS, SESSIONS
from .registry import query, sql
from .survey_queries import BASE, DAILY, PHQ9_PARTS, RESPONSES, scored_parts

SLOTS = [f"hour_{i}" for i in range(HOURS)]
CATEGORIES = [f"most_used_category_sw{i}" for i in range(LOOKBACK // SIZE)]
AMOUNTS = [f"{c}_sw{i}" for i in range(LOOKBACK // SIZE) for c in ("most_used_category_time", "num_apps")]
ID = "survey_response_id"

# ------------------------------------------------------------------ features

_FEATURES = ", ".join([*SLOTS, *[f"coalesce({c}, 0) AS {c}" for c in AMOUNTS], *[f"coalesce({c}, 'missing') AS {c}" for c in CATEGORIES]])


def matrix_of(b) -> DataFrame:
    return mlprep.feature_matrix(combined_of(b), keep=[ID, "app_user_id", LABEL], exclude=["ref_ts"])


@query("feature_matrix", sql(f"SELECT survey_response_id, app_user_id, risk_label, {_FEATURES} FROM combined", COMBINED_VIEWS, COMBINED))
def feature_matrix(b):
    return matrix_of(b)


@query("label_encode", sql("SELECT survey_response_id, app_user_id, risk_label, CAST(risk_label = 'at_risk' AS DOUBLE) AS label FROM surveys", SURVEYS))
def label_encode(b):
    return mlprep.encode_binary(b.surveys.select(ID, "app_user_id", LABEL), LABEL, "at_risk")


# The app categories of the benchmark tables, and the blank.
_LEVELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "missing"]
_HOT = ", ".join(f"CAST(coalesce(most_used_category_sw0, 'missing') = '{v}' AS INT) AS most_used_category_sw0_{v}" for v in _LEVELS[1:])


@query("onehot_features", sql(f"SELECT survey_response_id, {_HOT} FROM combined", COMBINED_VIEWS, COMBINED))
def onehot_features(b):
    rows = matrix_of(b).select(ID, "most_used_category_sw0")
    return mlprep.one_hot(rows, "most_used_category_sw0", _LEVELS, drop_first=True)


@query("hashed_features")
def hashed_features(b):
    hashed = mlprep.hash_features(matrix_of(b).select(ID, *CATEGORIES), CATEGORIES)
    return hashed.select(ID, vector_to_array("hashed").alias("hashed"))


def model_frame(b) -> tuple[DataFrame, list[str]]:
    """Numeric features and ``label`` for the classifiers, with its feature names."""
    rows = materialize(matrix_of(b), "features")
    for column in CATEGORIES:
        rows = mlprep.one_hot(rows, column, _LEVELS)
    rows = mlprep.encode_binary(rows, LABEL, "at_risk")
    return rows, [c for c in rows.columns if c not in (ID, "app_user_id", LABEL, "label")]


# -------------------------------------------------------------------- splits

_SPLIT = """SELECT *, row_number() OVER (PARTITION BY risk_label ORDER BY md5(concat('42|', survey_response_id)), survey_response_id) AS rn,
  count(*) OVER (PARTITION BY risk_label) AS n FROM {t}"""
SPLIT_PARTS = {"s": _SPLIT.format(t="surveys"), "split": "SELECT *, rn <= ceil(CAST(0.3 AS DOUBLE) * n) AS is_test FROM s"}
_SPLIT_OUT = "SELECT survey_response_id, app_user_id, risk_label, is_test FROM split"


def split_of(rows: DataFrame) -> DataFrame:
    return mlprep.split_stratified(rows, ID, LABEL)


@query("split_stratified", sql(_SPLIT_OUT, SURVEYS, SPLIT_PARTS))
def split_stratified(b):
    return split_of(b.surveys).select(ID, "app_user_id", LABEL, "is_test")


@query("split_by_user", sql("""SELECT survey_response_id, app_user_id, risk_label, user_n > 1 AND rn <= ceil(CAST(0.3 AS DOUBLE) * n) AS is_test FROM (
  SELECT *, row_number() OVER (PARTITION BY app_user_id, stratum ORDER BY md5(concat('42|', survey_response_id)), survey_response_id) AS rn,
    count(*) OVER (PARTITION BY app_user_id, stratum) AS n FROM strata)""", SURVEYS, {
        "classes": "SELECT app_user_id, risk_label, count(*) AS c FROM surveys GROUP BY 1, 2",
        "strata": """SELECT s.*, u.user_n, CASE WHEN k > 1 AND smallest >= 2 THEN risk_label ELSE '' END AS stratum FROM surveys s
          JOIN (SELECT app_user_id, sum(c) AS user_n, count(*) AS k, min(c) AS smallest FROM classes GROUP BY 1) u USING (app_user_id)"""}))
def split_by_user(b):
    return mlprep.split_by_user(b.surveys, ID, LABEL).select(ID, "app_user_id", LABEL, "is_test")


@query("split_temporal", sql(_SPLIT_OUT, SURVEYS, {"t": TEMPORAL, "split": TEMPORAL_SPLIT}))
def split_temporal(b):
    return mlprep.split_temporal(b.surveys, ID, "survey_ts").select(ID, "app_user_id", LABEL, "is_test")


_ENCODED = {"e": "SELECT *, CAST(risk_label = 'at_risk' AS INT) AS y FROM surveys"}


def encoded_of(b) -> DataFrame:
    return mlprep.encode_binary(b.surveys, LABEL, "at_risk")


@query("fold_assign", sql("""SELECT app_user_id, CAST(count(*) AS BIGINT) AS test_rows,
  (SELECT sum(y) FROM e) > sum(y) AND (SELECT sum(1 - y) FROM e) > sum(1 - y) AS usable FROM e GROUP BY 1""", SURVEYS, _ENCODED))
def fold_assign(b):
    return mlprep.fold_report(encoded_of(b))


FOLDS = {
    "f": """SELECT *, row_number() OVER (PARTITION BY risk_label ORDER BY md5(concat('42|', survey_response_id)), survey_response_id) AS rn FROM surveys""",
    "k": "SELECT least(5, min(c)) AS k, count(*) AS classes FROM (SELECT count(*) AS c FROM surveys GROUP BY risk_label)",
}


@query("stratified_folds", sql("""SELECT survey_response_id, risk_label, CASE WHEN k >= 2 AND classes > 1 THEN CAST((rn - 1) % k AS INT) END AS fold FROM f CROSS JOIN k""", SURVEYS, FOLDS))
def stratified_folds(b):
    return mlprep.stratified_folds(b.surveys, ID, LABEL).select(ID, LABEL, "fold")


@query("fold_validity", sql("""SELECT CAST((rn - 1) % k AS INT) AS fold, CAST(count(*) AS BIGINT) AS rows,
  count(*) FILTER (risk_label = 'at_risk') BETWEEN 1 AND (SELECT count(*) FROM f WHERE risk_label = 'at_risk') - 1
  AND count(*) FILTER (risk_label <> 'at_risk') BETWEEN 1 AND (SELECT count(*) FROM f WHERE risk_label <> 'at_risk') - 1 AS usable
FROM f CROSS JOIN k GROUP BY 1""", SURVEYS, FOLDS))
def fold_validity(b):
    return mlprep.fold_validity(mlprep.stratified_folds(encoded_of(b), ID, LABEL))


@query("class_weights", sql("""SELECT CAST(y AS DOUBLE) AS label, CAST(count(*) AS BIGINT) AS rows,
  round((SELECT count(*) FROM e) / ((SELECT count(DISTINCT y) FROM e) * count(*)), 6) AS weight,
  round((SELECT sum(1 - y) / sum(y) FROM e), 6) AS neg_pos_ratio FROM e GROUP BY y""", SURVEYS, _ENCODED))
def class_weights(b):
    return mlprep.class_weights(encoded_of(b))


_DRAWN = {
    "e": "SELECT survey_response_id, app_user_id, CAST(risk_label = 'at_risk' AS DOUBLE) AS label FROM surveys",
    "n": "SELECT label, count(*) AS c FROM e GROUP BY 1",
    "w": "SELECT label, CAST((SELECT sum(c) FROM n) AS DOUBLE) / CAST((SELECT count(*) FROM n) * c AS DOUBLE) AS weight FROM n",
    "r": "SELECT label, CAST(ceil(weight) AS INT) AS trials, weight / ceil(weight) AS rate FROM w",
    "cdf": """SELECT label, i, sum(exp(-rate) * pow(rate, i) / factorial(CAST(i AS INT))) OVER (PARTITION BY label ORDER BY i) AS upto
      FROM (SELECT label, rate, unnest(range(24)) AS i FROM r)""",
    "t": "SELECT survey_response_id, app_user_id, label, unnest(range(1, trials + 1)) AS trial FROM e JOIN r USING (label)",
    "u": """SELECT *, CAST('0x' || substr(md5(concat('42|', survey_response_id, '|', trial)), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS u FROM t""",
}


@query("weighted_resample", sql("SELECT survey_response_id, app_user_id, u.label FROM u JOIN cdf ON u.label = cdf.label AND u.u > cdf.upto", SURVEYS, _DRAWN))
def weighted_resample(b):
    return mlprep.weighted_resample(encoded_of(b).select(ID, "app_user_id", "label"), ID)


_STD = ", ".join(
    f"""round(CASE WHEN (SELECT stddev_pop({c}) FROM train) > 0 THEN ({c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train)
    ELSE {c} - (SELECT avg({c}) FROM train) END + 0.0, 4) + 0.0 AS {c}""" for c in SLOTS)


@query("standardize", sql(f"SELECT survey_response_id, {_STD} FROM split", EVENTS + SURVEYS, STD_PARTS | {
    "slots": STD_SLOTS, "s": _SPLIT.format(t="slots"), "split": SPLIT_PARTS["split"], "train": "SELECT * FROM split WHERE NOT is_test"}))
def standardize(b):
    rows = materialize(split_of(standard_slots(b)), "split")
    scaled = mlprep.scale(rows, mlprep.fit_scaler(rows.where(~F.col("is_test")), SLOTS))
    return scaled.select(ID, *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in SLOTS])


_NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in SLOTS)
_OPEN = f"""SELECT survey_response_id, app_user_id, ref_ts, risk_label, {slot_columns(HOURS, None)} FROM refs JOIN pairs USING (survey_response_id) GROUP BY 1, 2, 3, 4"""


@query("validation_report", sql(f"""SELECT rows, columns, round(missing_share, 6) AS missing_share, classes, round(hi / lo, 6) AS imbalance,
  rows < 10 AS too_few_rows, columns < 1 AS too_few_columns, missing_share > 0.5 AS many_missing, classes < 2 AS single_class,
  classes >= 2 AND hi / lo > 10 AS imbalanced FROM (
  SELECT CAST(count(*) AS BIGINT) AS rows, {HOURS + 4} AS columns, ({_NULLS}) / (count(*) * {HOURS + 4}) AS missing_share,
    (SELECT CAST(count(*) AS BIGINT) FROM c) AS classes, (SELECT max(n) FROM c) AS hi, (SELECT min(n) FROM c) AS lo FROM open)""",
                                EVENTS + SURVEYS, GRID_PARTS | slot_sql(_OWN_TIME, HOURS, None) | {
                                    "open": _OPEN, "c": "SELECT risk_label, count(*) AS n FROM open GROUP BY 1"}))
def validation_report(b):
    rows = lookback.lookback_slots(hourly_of(b), b.surveys, "hourly_steps", HOURS, fill=None, keep=[LABEL])
    return mlprep.validation_report(rows, LABEL)


# ------------------------------------------------------------------- metrics

SCORED = ["scored"]
PRED = {"pred": "SELECT *, CAST(score >= 0.5 AS INT) AS y_pred, list_extract([3, 6, 9, 12], CAST(id % 4 AS INT) + 1) AS window_hours, CAST(id % 5 AS INT) AS fold FROM scored"}


def scored_of(b) -> DataFrame:
    window = F.element_at(F.array(*[F.lit(w) for w in (3, 6, 9, 12)]), (F.col("id") % 4 + 1).cast("int"))
    return b.scored.withColumns({"y_pred": (F.col("score") >= 0.5).cast("int"), "window_hours": window, "fold": (F.col("id") % 5).cast("int")})


@query("confusion_matrix", sql(f"SELECT model, {COUNTS} FROM pred GROUP BY 1", SCORED, PRED))
def confusion_matrix(b):
    return metrics.confusion(scored_of(b), ["model"])


BY_WINDOW = PRED | metric_parts(f"SELECT model, window_hours, {COUNTS} FROM pred GROUP BY 1, 2")


def results_of(b) -> DataFrame:
    return metrics.classification_metrics(metrics.confusion(scored_of(b), ["model", "window_hours"]))


@query("classification_metrics", sql(f"SELECT model, window_hours, {METRIC_OUT} FROM measured", SCORED, BY_WINDOW))
def classification_metrics(b):
    return results_of(b)


CURVE = PRED | {
    "hits": "SELECT model, score AS threshold, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM pred GROUP BY 1, 2",
    "curve": """SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY threshold DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY threshold DESC) AS fp,
      sum(pos) OVER (PARTITION BY model) AS positives, sum(neg) OVER (PARTITION BY model) AS negatives FROM hits""",
}


@query("roc_curve", sql("""SELECT model, round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  round(tp / positives, 6) AS tpr, round(fp / negatives, 6) AS fpr FROM curve""", SCORED, CURVE))
def roc_curve(b):
    return metrics.roc_points(b.scored, ["model"]).select("model", "threshold", "tp", "fp", "tpr", "fpr")


@query("roc_auc", sql("""SELECT model, round(CAST(sum(r) FILTER (y_true = 1) - p * (p + 1) / 2 AS DOUBLE) / (p * q), 6) AS auc FROM (
  SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS r,
    sum(y_true) OVER (PARTITION BY model) AS p, sum(1 - y_true) OVER (PARTITION BY model) AS q FROM scored) GROUP BY model, p, q""", SCORED))
def roc_auc(b):
    return metrics.roc_auc(b.scored, ["model"])


_MEANS = ["accuracy", "precision", "recall", "f1", "balanced_accuracy"]


@query("fold_metrics", sql(f"""SELECT model, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn,
  {", ".join(f"round(avg({m}), 6) AS {m}" for m in _MEANS)} FROM (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (recall + specificity) / 2 AS balanced_accuracy FROM measured) GROUP BY 1""",
                           SCORED, PRED | metric_parts(f"SELECT model, fold, {COUNTS} FROM pred GROUP BY 1, 2")))
def fold_metrics(b):
    per_fold = metrics.classification_metrics(metrics.confusion(scored_of(b), ["model", "fold"]))
    return metrics.mean_over_folds(per_fold, ["model"], _MEANS)


@query("ragged_mean", sql("""SELECT CAST(pos AS INT) AS pos, round(avg(v), 6) AS mean FROM (
  SELECT sum(value) AS v, row_number() OVER (PARTITION BY app_user_id ORDER BY CAST(start_timestamp AS DATE)) - 1 AS pos
  FROM metric_events GROUP BY app_user_id, CAST(start_timestamp AS DATE)) GROUP BY 1""", EVENTS))
def ragged_mean(b):
    daily = b.metric_events.groupBy("app_user_id", F.to_date("start_timestamp").alias("date")).agg(F.sum("value").alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct("date", "v")))
    sequences = daily.groupBy("app_user_id").agg(F.transform(pairs, lambda e: e["v"]).alias("sequence"))
    return metrics.ragged_mean(sequences, [], "sequence").select(F.posexplode("mean_sequence").alias("pos", "mean"))


@query("best_config", sql("""SELECT criterion, model, window_hours, round(value, 6) AS value FROM (
  SELECT criterion, model, window_hours, value FROM (UNPIVOT (SELECT model, window_hours, f1, (recall + specificity) / 2 AS balanced_accuracy, recall,
      (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM measured) ON f1, balanced_accuracy, recall, accuracy INTO NAME criterion VALUE value)
  QUALIFY row_number() OVER (PARTITION BY criterion, model ORDER BY round(value, 9) DESC NULLS LAST, window_hours) = 1)""", SCORED, BY_WINDOW))
def best_config(b):
    results = results_of(b)
    names = ["f1", "balanced_accuracy", "recall", "accuracy"]
    cells = ", ".join(f"'{m}', round({m}, 9)" for m in names)
    long = results.select("model", "window_hours", F.expr(f"stack({len(names)}, {cells}) as (criterion, value)"))
    return metrics.best_rows(long, ["criterion", "model"], "value", ["window_hours"])


@query("results_table", sql(f"""SELECT 'risk' AS target, split_mode, model, window_hours, {METRIC_OUT} FROM measured""", SCORED, PRED | metric_parts(
    f"""SELECT 'pooled' AS split_mode, model, window_hours, {COUNTS} FROM pred GROUP BY 1, 2, 3 UNION ALL
    SELECT 'fold_' || fold, model, window_hours, {COUNTS} FROM pred GROUP BY 1, 2, 3""")))
def results_table(b):
    scored = scored_of(b)
    parts = [
        metrics.confusion(scored.withColumn("split_mode", mode), ["split_mode", "model", "window_hours"])
        for mode in (F.lit("pooled"), F.concat(F.lit("fold_"), F.col("fold")))
    ]
    table = metrics.classification_metrics(reduce(DataFrame.unionByName, parts)).withColumn("target", F.lit("risk"))
    return table.orderBy(F.col("f1").desc_nulls_last(), "split_mode", "model", "window_hours")


# -------------------------------------------------------------------- models

def _predict(b, name: str, **params) -> DataFrame:
    rows, columns = model_frame(b)
    split = materialize(mlprep.split_stratified(rows, ID, "label"), "split")
    return models.fit_predict(name, split, ID, columns, **params)


@query("lr_predictions")
def lr_predictions(b):
    return _predict(b, "lr")


@query("rf_predictions")
def rf_predictions(b):
    return _predict(b, "rf", scaled=False)


@query("gbt_predictions")
def gbt_predictions(b):
    return _predict(b, "gbt", scaled=False)


@query("mlp_predictions")
def mlp_predictions(b):
    return _predict(b, "mlp")


@query("louo_predictions")
def louo_predictions(b):
    rows, columns = model_frame(b)
    return models.louo_predict("lr", rows, ID, columns)


@query("louo_membership", sql("""SELECT e.survey_response_id, CAST(e.app_user_id AS VARCHAR) AS fold, e.y AS y_true FROM (
  SELECT survey_response_id, app_user_id, CAST(risk_label = 'at_risk' AS INT) AS y FROM combined) e
  JOIN (SELECT app_user_id FROM (SELECT app_user_id, sum(y) AS p, sum(1 - y) AS q, sum(sum(y)) OVER () AS ps, sum(sum(1 - y)) OVER () AS qs FROM (
    SELECT app_user_id, CAST(risk_label = 'at_risk' AS INT) AS y FROM combined) GROUP BY 1) WHERE ps > p AND qs > q) u USING (app_user_id)""", COMBINED_VIEWS, COMBINED))
def louo_membership(b):
    """Who is scored in which fold with which truth, from the scores of every user's model."""
    return louo_predictions(b).select(ID, "fold", "y_true")


@query("rf_importance")
def rf_importance(b):
    rows, columns = model_frame(b)
    weighted = models.assemble(models.dealt(mlprep.with_class_weight(rows), len(columns), ID), columns).persist()
    try:
        fitted = models.make_model("rf").fit(weighted)
    finally:
        weighted.unpersist()
    return models.feature_importances(fitted, columns, b.spark)


@query("tuned_lr")
def tuned_lr(b):
    """Every draw with its mean recall over five folds of the training rows; the best one also with its
    confusion counts on the test rows."""
    rows, columns = model_frame(b)
    split = materialize(mlprep.split_stratified(rows, ID, "label"), "split")
    train = materialize(mlprep.with_class_weight(mlprep.stratified_folds(split.where(~F.col("is_test")), ID, "label")).hint("rebalance"), "folds")
    folds = train.agg(F.max("fold")).first()[0] + 1
    search = models.random_search("lr", columns, train, "fold", folds)
    scored = models.score_frame(search.bestModel.transform(split.where("is_test")), ID)
    hit = metrics.confusion(scored, []).first()
    best = max(range(len(search.avgMetrics)), key=lambda i: search.avgMetrics[i])
    table = []
    for i, (grid, score) in enumerate(zip(search.getEstimatorParamMaps(), search.avgMetrics)):
        values = {p.name: float(v) for p, v in grid.items()}
        counts = [int(hit[c]) for c in ("tp", "fp", "fn", "tn")] if i == best else [None] * 4
        table.append((i, values["elasticNetParam"], values["regParam"], float(score), i == best, *counts))
    return b.spark.createDataFrame(
        table, "draw int, elasticNetParam double, regParam double, recall double, best boolean, tp long, fp long, fn long, tn long")


def _tuned_trees(b, name: str) -> DataFrame:
    """Every draw with its mean recall over five folds of the training rows; the best one also with its confusion
    counts on the test rows."""
    rows, columns = model_frame(b)
    split = materialize(mlprep.split_stratified(rows, ID, "label"), "split")
    train = materialize(mlprep.with_class_weight(mlprep.stratified_folds(split.where(~F.col("is_test")), ID, "label")).hint("rebalance"), "folds")
    folds = train.agg(F.max("fold")).first()[0] + 1
    table, best, model = models.staged_search(name, columns, train, "fold", folds, parallelism=8)
    hit = metrics.confusion(models.score_frame(model.transform(models.assemble(split.where("is_test"), columns)), ID), []).first()
    for t in (split, train):
        release(t)
    names = list(models.SPACES[name])
    out = [(i, *[float(point[n]) for n in names], recall, point == best, *([hit.tp, hit.fp, hit.fn, hit.tn] if point == best else [None] * 4))
           for i, (point, recall) in enumerate(table)]
    return b.spark.createDataFrame(out, f"draw int, {', '.join(f'{n} double' for n in names)}, recall double, best boolean, tp long, fp long, fn long, tn long")


@query("tuned_rf")
def tuned_rf(b):
    return _tuned_trees(b, "rf")


# -------------------------------------------------------------- sweep results

_SWEEP_SPLIT = {"one_per_day": ONE_PER_DAY, "grid": SWEEP_PARTS["grid"], "s": _SPLIT.format(t="one_per_day"), "split": SPLIT_PARTS["split"]}


def sweep_table(b, names: tuple[str, ...] = sweep.MODELS) -> DataFrame:
    return sweep.sweep_results(b.category_sessions, one_per_day_of(b), LABEL, "at_risk", _LEVELS[:-1], names)


@query("sweep_results")
def sweep_results(b):
    """The logistic models of every pair of the grid, with supports and metrics."""
    return sweep_table(b, ("lr",))


@query("sweep_forests")
def sweep_forests(b):
    """The forests of every pair of the grid, as rows like those of ``sweep_results``."""
    return sweep_table(b, ("rf",))


@query("sweep_supports", sql("""SELECT lookback_hours, subwindow_hours, n_samples, n_train, n_test, support_positive, support_negative FROM grid CROSS JOIN (
  SELECT count(*) AS n_samples, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test,
    count(*) FILTER (is_test AND risk_label = 'at_risk') AS support_positive, count(*) FILTER (is_test AND risk_label <> 'at_risk') AS support_negative FROM split)""",
                             SURVEYS, _SWEEP_SPLIT))
def sweep_supports(b):
    """Keys and supports, as the trained models' confusion counts give them."""
    return sweep_table(b, ("lr",)).select(
        "lookback_hours", "subwindow_hours", "n_samples", "n_train", "n_test", "support_positive", "support_negative")


@query("sweep_f1_heatmap")
def sweep_f1_heatmap(b):
    """Mean F1 over models by sub-window and lookback: the logistic models and the forests of every pair."""
    return metrics.pivot_metric(sweep_table(b), "subwindow_hours", "lookback_hours", list(range(1, 31)), "f1")


@query("sweep_best")
def sweep_best(b):
    return sweep.best_pairs(sweep_table(b, ("lr",)))


# --------------------------------------------------------------- experiments

_RANKED = """SELECT *, row_number() OVER (PARTITION BY window_hours, risk_label ORDER BY md5(concat('42|', survey_response_id)), survey_response_id) AS rs,
  count(*) OVER (PARTITION BY window_hours, risk_label) AS ns, row_number() OVER u AS rt, count(*) OVER (PARTITION BY window_hours, app_user_id) AS nt,
  CAST(risk_label = 'at_risk' AS INT) AS y_true, CAST(first_value(risk_label) OVER u = 'at_risk' AS INT) AS y_pred
  , count(*) OVER v AS nu, row_number() OVER (PARTITION BY window_hours, app_user_id, CASE WHEN kinds > 1 AND least_n >= 2 THEN risk_label ELSE '' END
      ORDER BY md5(concat('42|', survey_response_id)), survey_response_id) AS ru,
  count(*) OVER (PARTITION BY window_hours, app_user_id, CASE WHEN kinds > 1 AND least_n >= 2 THEN risk_label ELSE '' END) AS ms
  FROM training JOIN (SELECT window_hours, app_user_id, count(*) AS kinds, min(n) AS least_n FROM (
    SELECT window_hours, app_user_id, risk_label, count(*) AS n FROM training GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (window_hours, app_user_id)
  WINDOW u AS (PARTITION BY window_hours, app_user_id ORDER BY ref_ts, survey_response_id), v AS (PARTITION BY window_hours, app_user_id)"""
_MODES = """SELECT *, 'stratified' AS split_mode, rs <= ceil(CAST(0.3 AS DOUBLE) * ns) AS is_test FROM ranked UNION ALL
  SELECT *, 'by_user', nu > 1 AND ru <= ceil(CAST(0.3 AS DOUBLE) * ms) FROM ranked UNION ALL
  SELECT *, 'temporal', nt > 1 AND rt > least(greatest(floor(nt * (CAST(1 AS DOUBLE) - CAST(0.3 AS DOUBLE))), 1), nt - 1) FROM ranked"""
_TESTED = COUNTS.replace("FILTER (y_true", "FILTER (is_test AND y_true")


def experiment(b, names: tuple[str, ...], **more) -> DataFrame:
    rows = experiments.stacked(training_of(b), {"risk": (LABEL, "at_risk")}, lambda w: [f"hour_{i}" for i in range(w)], lookback.TRAINING_WINDOWS, ID)
    return experiments.run_experiments(rows, ID, names, **more)


@query("experiment_design", sql(f"SELECT 'risk' AS target, window_hours, split_mode, 'baseline' AS model, n_train, n_test, {METRIC_OUT} FROM measured", EVENTS + SURVEYS,
                                STD_PARTS | {"training": MULTI_SLOTS, "ranked": _RANKED, "modes": _MODES} | metric_parts(
    f"""SELECT window_hours, split_mode, CAST(count(*) FILTER (NOT is_test) AS BIGINT) AS n_train,
        CAST(count(*) FILTER (is_test) AS BIGINT) AS n_test, {_TESTED} FROM modes GROUP BY 1, 2""")))
def experiment_design(b):
    """Split sizes, supports and the persistence baseline of every experiment, without the trained models."""
    return experiment(b, ())


@query("experiment_results")
def experiment_results(b):
    """Logistic models and forests on three splits of four windows, and the baseline beside them."""
    return experiment(b, ("lr", "rf"))


# ------------------------------------------------------- all targets together

TARGET_WINDOWS = [12, 24, 48]


def target_rows(b) -> DataFrame:
    """The ten targets' labels of each survey with the hourly app usage before it, in three windows.

    A survey without usage in the longest window has no row, and usage that no survey's window touches counts nowhere:
    sessions are cut to the days before surveys, then surveys to those near usage, and only their answers are pivoted."""
    hours = max(TARGET_WINDOWS)
    asked = b.survey_response.where(F.col("survey_id").isin(surveys.MORNING, surveys.AFTERNOON)).select(
        "id", "app_user_id", lenient_timestamp(F.col("survey_ts")).alias("survey_ts"))
    sessions = clean.app_sessions(b.screentime_app, b.screentime, days=lookback.survey_days(asked), reach=lookback.reach_days(hours))
    usage = materialize(timegrid.hourly_screentime(sessions).select("app_user_id", "datetime", "hourly_screentime"), "target-usage")
    near = lookback.near_usage(asked, usage, hours).select("id").distinct()
    responses = materialize(b.survey_response.join(near, "id", "left_semi"), "target-responses")
    severity = surveys.phq9_scores(responses, b.answer).select(ID, "severity_label")
    labelled = surveys.daily_labels(responses, b.daily_answer).join(severity, ID, "left")
    columns = [column for column, _, _ in rules.TARGETS.values()]
    wide = lookback.multiwindow_slots(usage, labelled, "hourly_screentime", TARGET_WINDOWS, keep=columns)
    targets = {name: (column, positive) for name, (column, positive, _) in rules.TARGETS.items()}
    return experiments.stacked(wide, targets, lambda w: [f"hour_{i}" for i in range(w)], TARGET_WINDOWS, ID)


_STACK = " UNION ALL ".join(
    f"SELECT survey_response_id, '{name}' AS target, {column} AS label, '{positive}' AS positive FROM all_labels" for name, (column, positive, _) in rules.TARGETS.items())


@query("target_supports", sql("""SELECT target, w AS window_hours, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (label = positive) AS BIGINT) AS positives
FROM held JOIN stack USING (survey_response_id) WHERE label IS NOT NULL AND label <> 'N/A' GROUP BY 1, 2""",
                              list(dict.fromkeys([*SESSIONS, *DAILY, *RESPONSES])), APP_PARTS | BASE | scored_parts("typed", False) | PHQ9_PARTS | {
    "all_labels": "SELECT l.*, p.severity_label FROM labels l LEFT JOIN phq9_labelled p USING (survey_response_id)",
    "usage_hours": "SELECT DISTINCT app_user_id, date_trunc('hour', calculated_start_time) AS datetime FROM app_sessions WHERE app_user_id IS NOT NULL",
    "held": f"""SELECT DISTINCT survey_response_id, w FROM (SELECT *, date_trunc('day', survey_ts) + to_hours(9) AS ref FROM all_labels) j
      CROSS JOIN (SELECT unnest({TARGET_WINDOWS}) AS w) JOIN usage_hours u ON u.app_user_id = j.app_user_id AND u.datetime < ref AND u.datetime >= ref - to_hours(w)""",
    "stack": _STACK}))
def target_supports(b):
    """Rows and positives of every target and window, as the experiments take them."""
    return target_rows(b).groupBy("target", "window_hours").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 1).alias("positives"))


def target_table(b) -> DataFrame:
    return experiments.run_experiments(target_rows(b), ID, ("lr",))


@query("target_experiments")
def target_experiments(b):
    """Every target in every window and split: the logistic models, solved together, and the baseline."""
    return target_table(b)


@query("target_comparison")
def target_comparison(b):
    return experiments.comparison(target_table(b)).select("target", "place", "window_hours", "split_mode", "model", "f1", "accuracy", "recall")


@query("target_best")
def target_best(b):
    return experiments.best_of(target_table(b))
