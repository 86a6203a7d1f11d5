"""Queries that run the fitted stages, the task factory and the column resolvers over whole tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import mlprep, models
from ..session import materialize, release
from . import stages
from .align_queries import LABEL
from .model_queries import COMBINED, COMBINED_VIEWS, ID, SPLIT_PARTS, _SPLIT, model_frame
from .registry import ORACLES, query, sql


@query("task_weekly", ORACLES["weekly_health_labels"])
def task_weekly(b):
    """The weekly task of the factory: grid and labels as pipeline stages."""
    labels = b.surveys.withColumns({"severity_label": F.col(LABEL), "phq9_total_score": F.col(ID)})
    return stages.build_task("health_weekly", labels).fit(b.metric_events).transform(b.metric_events)


@query("task_multiwindow", ORACLES["multiwindow_training"])
def task_multiwindow(b):
    """The step task: the hourly grid, one survey per user-day and all training windows as pipeline stages."""
    labels = b.surveys.withColumnRenamed(LABEL, "suicide_risk_label")
    out = stages.steps_task("suicide_risk", labels).fit(b.metric_events).transform(b.metric_events)
    return out.withColumnRenamed("suicide_risk_label", LABEL)


# What the resolvers find: by preference of names, and by a column's content where no name is known.
_RESOLVED = """SELECT * FROM (VALUES ('metric_events', 'value', 'start_timestamp'), ('screentime', 'id', 'start_time'),
  ('payloads', 'id', 'created_at'), ('texts', 'survey_response_id', 'answer_ts'), ('clock_answers', 'id', NULL)) t(table_name, value_column, timestamp_column)"""


@query("resolved_columns", _RESOLVED)
def resolved_columns(b):
    """Value and timestamp column of each table, the latter from one pass over its candidates."""
    texts = b.surveys.select(ID, F.lit("x").alias("answer"), F.date_format("survey_ts", "yyyy-MM-dd HH:mm:ss").alias("answer_ts"))
    tables = {"metric_events": b.metric_events, "screentime": b.screentime, "payloads": b.payloads.drop("payload"), "texts": texts,
              "clock_answers": b.clock_answers.select("id", F.lit("none").alias("note"))}
    found = [(name, columns.value_column(df), columns.timestamp_column(df)) for name, df in tables.items()]
    return b.spark.createDataFrame(found, "table_name string, value_column string, timestamp_column string")


@query("prediction_membership", sql("""SELECT model, survey_response_id, CAST(risk_label = 'at_risk' AS INT) AS y_true
FROM split CROSS JOIN (VALUES ('forest'), ('lr'), ('mlp'), ('rf')) m(model) WHERE is_test""", COMBINED_VIEWS,
                                    COMBINED | {"s": _SPLIT.format(t="combined"), "split": SPLIT_PARTS["split"]}))
def prediction_membership(b):
    """Which rows each model scores, with which truth: the default models, a custom one and the net, trained and applied."""
    rows, names = model_frame(b)
    split = materialize(mlprep.split_stratified(rows, ID, "label"), "split")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    custom = models.model_map({"forest": models.make_model("rf", weighted=False, numTrees=20, maxDepth=4)}, len(names))

    def scored(name: str) -> DataFrame:
        if name in custom:
            rows = models.assemble(models.dealt(train, len(names), ID, models.FOREST_BYTES), names).persist()
            try:
                fitted = custom[name].fit(rows)
            finally:
                rows.unpersist()
            found = models.score_frame(fitted.transform(models.assemble(test, names)), ID)
        else:
            found = models.fit_predict(name, split, ID, names, scaled=name != "rf")
        return materialize(found, "scores").withColumn("model", F.lit(name))

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(inheritable_thread_target(b.spark)(scored), ["mlp", "rf", "lr", *custom]))
    release(split)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("score").between(0, 1) & F.col("y_pred").isin(0, 1)).select("model", ID, "y_true")
