"""Stacked experiments: rows, splits, results and resuming."""

import pytest
from pyspark.sql import functions as F

from cohortgrid.operators import experiments, mlprep, models, sweep

ROWS = "id long, app_user_id long, ref_ts timestamp, window_hours int, one string, two string, hour_0 double, hour_1 double"
TARGETS = {"first": ("one", "yes"), "second": ("two", "bad")}


@pytest.fixture(scope="module")
def training(spark):
    out = []
    for i in range(80):
        one, two = ("yes" if (i * 7) % 5 < 2 else "no"), ("bad" if i % 3 == 0 else "N/A" if i % 10 == 1 else None if i % 10 == 2 else "good")
        for w in (1, 2):
            out.append((i, i % 9, f"2024-01-{1 + i % 28:02d} 0{i % 9}:00:00", w, one, two, float((i * 7) % 5) + i % 2, None if w == 1 else float(i % 4)))
    text = ROWS.replace("timestamp", "string")
    return spark.createDataFrame(out, text).withColumn("ref_ts", F.to_timestamp("ref_ts")).cache()


def features(w):
    return [f"hour_{i}" for i in range(w)]


@pytest.fixture(scope="module")
def rows(training):
    return experiments.stacked(training, TARGETS, features, [1, 2], "id").cache()


def test_stacked_rows(rows):
    got = rows.collect()
    assert {(r.target, r.window_hours, r.id) for r in got if r.target == "first"} == {("first", w, i) for w in (1, 2) for i in range(80)}
    assert {r.id for r in got if r.target == "second"} == {i for i in range(80) if i % 3 == 0 or i % 10 not in (1, 2)}
    assert all(len(r.x) == r.window_hours and None not in r.x for r in got)
    assert {r.label for r in got} == {0.0, 1.0}


def test_splits_are_those_of_each_experiment_alone(rows, training):
    table = experiments.split_all(rows, "id").cache()
    for target, (column, positive) in TARGETS.items():
        alone = mlprep.encode_binary(training.where("window_hours = 2"), column, positive)
        want = {
            "stratified": mlprep.split_stratified(alone, "id", "label"),
            "by_user": mlprep.split_by_user(alone, "id", "label"),
            "temporal": mlprep.split_temporal(alone, "id", "ref_ts"),
        }
        for mode, split in want.items():
            part = table.where((F.col("target") == target) & (F.col("window_hours") == 2) & (F.col("split_mode") == mode))
            assert {(r.id, r.is_test) for r in part.collect()} == {(r.id, r.is_test) for r in split.select("id", "is_test").collect()}
    with pytest.raises(ValueError, match="unknown split mode"):
        experiments.split_all(rows, "id", ["random"])


def test_joint_models_score_like_single_fits_and_resume(rows, training, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/results"
    first = experiments.run_experiments(rows, "id", ("lr",), ("stratified",), path=path).collect()
    assert {(r.target, r.window_hours, r.model) for r in first} == {(t, w, m) for t in TARGETS for w in (1, 2) for m in ("lr", "baseline")}
    alone = mlprep.split_stratified(mlprep.encode_binary(training.where("window_hours = 2"), "one", "yes"), "id", "label")
    scored = models.fit_predict("lr", alone.na.fill(0.0, features(2)), "id", features(2)).collect()
    row = next(r for r in first if (r.target, r.window_hours, r.model) == ("first", 2, "lr"))
    assert row.tp == sum(s.y_true == s.y_pred == 1 for s in scored) and row.n_test == len(scored)

    def broken(*args):
        raise AssertionError("run again")

    monkeypatch.setattr(experiments, "_joint", broken)
    again = experiments.run_experiments(rows, "id", ("lr",), ("stratified",), path=path).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
    with pytest.raises(AssertionError, match="run again"):
        experiments.run_experiments(rows, "id", ("lr",), ("stratified", "temporal"), path=path)


def test_models_fitted_one_by_one(rows, tmp_path):
    """Boosted trees, with the caller's settings; a row that is there already is kept."""
    path = f"file://{tmp_path}/boosted"
    got = experiments.run_experiments(rows.where("target = 'first'"), "id", ("gbt",), ("by_user",), baseline=False, path=path, maxIter=2, maxDepth=2).collect()
    assert {(r.window_hours, r.model) for r in got} == {(1, "gbt"), (2, "gbt")}
    assert all(r.tp + r.fp + r.fn + r.tn == r.n_test > 0 for r in got)
    again = experiments.run_experiments(rows.where("target = 'first'"), "id", ("gbt",), ("by_user",), baseline=False, path=path, maxIter=0).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_comparison_and_best(rows):
    results = experiments.run_experiments(rows, "id", ("lr",), ("temporal", "by_user")).cache()
    ordered = experiments.comparison(results).collect()
    for target in TARGETS:
        mine = sorted((r for r in ordered if r.target == target), key=lambda r: r.place)
        assert [round(r.f1, 9) for r in mine] == sorted((round(r.f1, 9) for r in mine), reverse=True)
    best = experiments.best_of(results).collect()
    assert {(r.target, r.criterion) for r in best} == {(t, c) for t in TARGETS for c in ("f1", "balanced_accuracy", "recall", "accuracy")}
    assert all(r.model == "lr" for r in best)


def test_sweep_models_equal_single_fits(spark, bound):
    """Both models of a small sweep: every pair once, and a pair's logistic model as fitted by itself."""
    from cohortgrid.operators import lookback
    from cohortgrid.plans.align_queries import one_per_day_of
    from cohortgrid.plans.model_queries import _LEVELS

    surveys, levels = one_per_day_of(bound).cache(), _LEVELS[:-1]
    got = sweep.sweep_results(bound.category_sessions, surveys, "risk_label", "at_risk", levels, max_lookback=3, trees=5).collect()
    pairs = {(1, 1), (2, 1), (2, 2), (3, 1), (3, 3)}
    assert {(r.lookback_hours, r.subwindow_hours, r.model) for r in got} == {(*p, m) for p in pairs for m in ("lr", "rf")}
    split = mlprep.split_stratified(mlprep.encode_binary(surveys, "risk_label", "at_risk").select("survey_response_id", "label"), "survey_response_id", "label")
    wide = lookback.sweep_vectors(bound.category_sessions, surveys, levels, 3).where("subwindow_hours = 1").join(split, "survey_response_id")
    width = 2 * (len(levels) + 1)
    columns = [f"f{i}" for i in range(width)]
    alone = wide.select("survey_response_id", "label", "is_test", *[F.col("x")[i].alias(c) for i, c in enumerate(columns)])
    train, test = alone.where(~F.col("is_test")), alone.where("is_test")
    fitted = mlprep.fit_scaler(train, columns)
    model = models.make_model("lr", weighted=False, tol=1e-13, maxIter=500).fit(models.assemble(mlprep.scale(train, fitted), columns))
    scored = model.transform(models.assemble(mlprep.scale(test, fitted), columns))
    tp = scored.where("label = 1 AND prediction = 1").count()
    row = next(r for r in got if (r.lookback_hours, r.subwindow_hours, r.model) == (2, 1, "lr"))
    assert (row.tp, row.n_test) == (tp, test.count())


def test_forests_are_dealt_finer_than_boosted_trees(spark):
    from cohortgrid.operators import models

    rows = spark.range(20_000).withColumnRenamed("id", "key")
    assert models.dealt(rows, 12, "key").rdd.getNumPartitions() == 1
    assert models.dealt(rows, 12, "key", models.FOREST_BYTES).rdd.getNumPartitions() == 4


def test_sweep_numbers_are_the_vectors_without_zeros(bound):
    """Surveys with usage by the numbers that are not 0, the others as counts: the same rows, with far fewer numbers."""
    from cohortgrid.operators import lookback
    from cohortgrid.plans.align_queries import one_per_day_of
    from cohortgrid.plans.model_queries import _LEVELS

    surveys, levels = one_per_day_of(bound).cache(), _LEVELS[:-1]
    few = {(r.survey_response_id, r.subwindow_hours): {i: v for i, v in zip(r.at, r.x)} for r in lookback.sweep_few(bound.category_sessions, surveys, levels, 30).collect()}
    vectors = lookback.sweep_vectors(bound.category_sessions, surveys, levels, 30).collect()
    assert all(few.get((r.survey_response_id, r.subwindow_hours), {}) == {i: v for i, v in enumerate(r.x) if v} for r in vectors)
    assert sum(map(len, few.values())) * 5 < sum(len(r.x) for r in vectors)
    split = mlprep.split_stratified(mlprep.encode_binary(surveys, "risk_label", "at_risk").select("survey_response_id", "label"), "survey_response_id", "label")
    counted = sweep._counted(lookback.sweep_few(bound.category_sessions, surveys, levels, 30), split.select("survey_response_id", "label", "is_test"), 30)
    assert {r.n for r in counted.groupBy("k").agg(F.sum("n").alias("n")).collect()} == {surveys.count()}
    assert counted.where("size(x) = 0").groupBy("k", "is_test", "label").count().where("count > 1").isEmpty()


def test_heat_map_is_the_mean_over_both_models(spark, bound, monkeypatch):
    """A cell is the mean of the F1 of a pair's logistic model and forest, not one model's."""
    from cohortgrid.plans import QUERIES

    made, whole = [], sweep.sweep_results

    def small(*args):
        made.append(whole(*args, max_lookback=2, trees=2).cache())
        return made[-1]

    monkeypatch.setattr(sweep, "sweep_results", small)
    got = {(r.subwindow_hours, n): r[str(n)] for r in QUERIES["sweep_f1_heatmap"](spark, bound.root).collect() for n in range(1, 31)}
    rows = made[0].collect()
    assert {(r.lookback_hours, r.subwindow_hours, r.model) for r in rows} == {(*p, m) for p in [(1, 1), (2, 1), (2, 2)] for m in ("lr", "rf")}
    for size, hours in [(1, 1), (1, 2), (2, 2)]:
        own = [r.f1 for r in rows if (r.lookback_hours, r.subwindow_hours) == (hours, size)]
        assert len(own) == 2 and got[(size, hours)] == pytest.approx(sum(own) / 2, abs=1e-6)
    assert got[(2, 1)] is None and len(got) == 2 * 30
