"""Every registered query against its SQL check, and plan shapes."""

import pytest
from oracle_check import compare, connect

from cohortgrid.plans import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
TRAINED = {"lr_predictions", "rf_predictions", "gbt_predictions", "mlp_predictions", "louo_predictions", "rf_importance", "tuned_lr"}


@pytest.fixture(scope="module")
def duck():
    con = connect(ROOT)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert unwanted not in plan
    assert compare(duck, df, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["hashed_features", "weighted_resample", "lr_predictions"])
def test_rows_only_queries(spark, name):
    assert QUERIES[name](spark, ROOT).count() > 0


def test_experiment_rows_follow_from_their_counts(spark):
    design = {(r.window_hours, r.split_mode): r for r in QUERIES["experiment_design"](spark, ROOT).collect()}
    got = QUERIES["experiment_results"](spark, ROOT).collect()
    assert {(r.window_hours, r.split_mode) for r in got} == set(design)
    for r in got:
        same = design[(r.window_hours, r.split_mode)]
        assert (r.n_train, r.n_test, r.support_positive) == (same.n_train, same.n_test, same.support_positive)
        assert r.tp + r.fp + r.fn + r.tn == r.n_test and r.accuracy == pytest.approx((r.tp + r.tn) / r.n_test, abs=1e-6)
        assert r.f1 == pytest.approx(2 * r.tp / max(1, 2 * r.tp + r.fp + r.fn), abs=1e-6)


@pytest.mark.parametrize("name", ["dedup_start", "latest_cumulative", "app_sessions", "one_survey_per_day", "weekly_labels", "top_apps"])
def test_first_rows_are_limited_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["hour_profile"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert TRAINED <= set(entry.queries())
