"""Stages, task factory, models and the streaming roll-up."""

import pytest
from pyspark.sql import functions as F

from cohortgrid.operators import clean, mlprep, models, timegrid
from cohortgrid.plans import stages
from cohortgrid.sources.catalog import Catalog, read_csv, refresh_dimension, write_csv
from cohortgrid.streaming.rollup import hourly_rollup, read_events, write_rollup


@pytest.fixture(scope="module")
def labels(bound):
    return bound.surveys.withColumnRenamed("risk_label", "suicide_risk_label")


def test_steps_task_equals_direct_calls(bound, labels):
    out = stages.steps_task("suicide_risk", labels, windows=[3, 6]).fit(bound.metric_events).transform(bound.metric_events)
    assert set(r.window_hours for r in out.select("window_hours").distinct().collect()) == {3, 6}
    assert out.where("window_hours = 3 AND hour_3 IS NOT NULL").count() == 0


def test_propagation_happens_after_the_merge(bound, labels):
    fitted = stages.subwindow_task("suicide_risk", labels, propagate=True).fit(bound.category_sessions)
    out = fitted.transform(bound.category_sessions)
    mixed = out.groupBy("app_user_id").agg(F.count_distinct("suicide_risk_label").alias("k")).where("k > 1")
    assert out.count() > 0 and mixed.count() == 0


def test_weekly_and_named_tasks(bound, labels):
    weekly = labels.withColumn("severity_label", F.col("suicide_risk_label")).withColumn("phq9_total_score", F.lit(3))
    assert stages.build_task("health_weekly", weekly).fit(bound.metric_events).transform(bound.metric_events).count() > 0
    app = clean.app_sessions(bound.screentime_app, bound.screentime)
    assert stages.build_task("screentime_suicide_risk", labels, windows=[3]).fit(app).transform(app).columns[-1] == "hour_2"
    assert len(stages.TASKS) == 11
    with pytest.raises(ValueError):
        stages.build_task("nothing", labels)


def test_selector_encoder_missing_validator(rows):
    df = rows("app_user_id long, hour_0 double, suicide_risk_label string", (1, 1.0, "at_risk"), (2, None, "not_at_risk"), (3, 5.0, "N/A"))
    assert stages.FeatureSelector().fit(df).transform(df).columns == ["hour_0"]
    encoded = stages.LabelEncoder(target="suicide_risk").transform(df)
    assert sorted(r.label for r in encoded.collect()) == [0.0, 1.0]
    filled = stages.MissingValues(strategy="mean", columns=["hour_0"]).fit(df).transform(df)
    assert sorted(r.hour_0 for r in filled.collect()) == [1.0, 3.0, 5.0]
    fitted = stages.DataValidator(labelCol="suicide_risk_label", minSamples=2).fit(df)
    assert fitted.valid and fitted.report["rows"] == 3


def test_custom_models_replace_the_default(spark):
    mine = {"tree": models.make_model("rf", numTrees=3)}
    assert models.model_map(mine, 4) is mine
    assert sorted(models.model_map(None, 4)) == ["lr", "rf"]
    with pytest.raises(ValueError):
        models.make_model("svm")


def test_learns_a_separable_label(spark):
    data = [(i, i % 10, float(i % 2), float(i % 2) * 3 + (i % 5) * 0.1) for i in range(200)]
    df = spark.createDataFrame(data, "id long, app_user_id long, label double, x double")
    split = mlprep.split_stratified(df, "id", "label")
    scored = models.fit_predict("lr", split, "id", ["x"]).collect()
    assert all(r.y_true == r.y_pred for r in scored) and len(scored) == 60
    pooled = models.louo_predict("lr", df, "id", ["x"], scheme="grouped", folds=3)
    assert pooled.count() == 200 and pooled.select("fold").distinct().count() == 3


def test_safe_recall(spark):
    one = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0)], "label double, prediction double")
    both = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    assert models.SafeRecall().evaluate(one) == 0.0
    assert models.SafeRecall().evaluate(both) == 0.5


def test_catalog_and_csv(spark, bound, tmp_path):
    catalog = Catalog(spark, tables={"step": bound.metric_events})
    assert catalog.table("steps").columns == bound.metric_events.columns
    with pytest.raises(KeyError):
        catalog.table("speed")
    write_csv(bound.surveys, f"{tmp_path}/s", ["survey_id"])
    back = read_csv(spark, [f"{tmp_path}/s", f"{tmp_path}/none"], bound.surveys.schema, with_file=True)
    assert back.count() == bound.surveys.count() and "file" in back.columns


def test_dimension_refresh(spark, rows, tmp_path):
    first = refresh_dimension(spark, f"{tmp_path}/v1", rows("app_name string", ("com.android.dialer",)))
    second = refresh_dimension(spark, f"{tmp_path}/v2", rows("app_name string", ("com.android.dialer",), ("zzz",)), f"{tmp_path}/v1")
    assert first.count() == 1 and second.count() == 2


def test_stream_equals_batch(spark, bound, tmp_path):
    source = f"{tmp_path}/in"
    bound.metric_events.write.parquet(source)
    stream = hourly_rollup(read_events(spark, source, bound.metric_events.schema), "2 hours")
    query = write_rollup(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    closed = spark.read.parquet(f"{tmp_path}/out").where("metric = 'steps'").select("app_user_id", "datetime", F.round("total", 6))
    batch = timegrid.bucket_metric(bound.metric_events.where("metric = 'steps'"), "sum", "H", value="value")
    batch = batch.select("app_user_id", F.col("time_key").alias("datetime"), F.round("value", 6))
    last = closed.agg(F.max("datetime")).first()[0]
    assert closed.count() > 0
    assert closed.exceptAll(batch).count() == 0
    assert batch.where(F.col("datetime") <= F.lit(last)).exceptAll(closed).count() == 0
