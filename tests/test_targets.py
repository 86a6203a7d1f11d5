"""The target tables: what is cut before answers and sessions are read, and what that must not change."""

from pyspark.sql import functions as F

from cohortgrid.functions import rules
from cohortgrid.operators import clean, experiments, lookback, timegrid


def test_sessions_cut_to_survey_days_are_the_same_on_them(rows):
    """A shifted first session, its repeats under other parents, and starts at both ends of the reach."""
    apps = rows("screentime_id long, line long, app_name string, app_category string, total_time_ms long, last_time_used ts",
                (1, 1, "a", "x", 3_600_000, "2024-01-10 00:30:00"), (2, 1, "a", "x", 3_600_000, "2024-01-10 00:30:00"),  # first, twice
                (2, 2, "b", "x", 60_000, "2024-01-08 12:00:00"), (2, 3, "b", "x", 60_000, "2024-01-11 12:00:00"),
                (3, 1, "c", "x", 60_000, "2024-01-09 12:00:00"), (4, 1, "c", "x", 86_400_000, "2024-02-01 12:00:00"),
                (5, 1, "c", "x", 60_000, "2024-01-09 12:00:00"), (None, 1, "c", "x", 60_000, "2024-01-09 12:00:00"))
    parents = rows("id long, app_user_id long, start_time ts, end_time ts", *[
        (1, 7, "2024-01-10 00:15:00", "2024-01-10 02:00:00"), (2, 7, "2024-01-10 00:15:00", "2024-01-10 02:00:00"),
        (3, 8, "2024-01-09 11:00:00", "2024-01-09 13:00:00"), (4, 8, "2024-01-31 11:00:00", "2024-02-02 13:00:00"),
        (5, None, "2024-01-09 11:00:00", "2024-01-09 13:00:00")])
    asked = rows("id long, app_user_id long, survey_ts ts", (1, 7, "2024-01-11 10:00:00"), (2, 8, "2024-02-02 08:00:00"),
                 (3, 8, None), (4, 9, "2024-01-09 08:00:00"), (5, None, "2024-01-09 08:00:00"))
    for reach in (0, 1, 2):
        day = F.to_date("calculated_start_time")
        near = asked.select("app_user_id", F.explode(F.sequence(F.date_add(F.to_date("survey_ts"), -reach), F.to_date("survey_ts"))).alias("_d")).distinct()
        on = lambda s: sorted(map(str, s.withColumn("_d", day).join(near, ["app_user_id", "_d"], "left_semi").collect()))
        whole, cut = clean.app_sessions(apps, parents), clean.app_sessions(apps, parents, days=lookback.survey_days(asked), reach=reach)
        assert on(whole) == on(cut) and cut.count() < whole.count()
    assert on(whole) and lookback.reach_days(48) == 2 and lookback.reach_days(9) == 0 and lookback.reach_days(10) == 1


def test_only_surveys_near_usage_have_their_answers_pivoted(bound):
    """The rows are those that all labels give; surveys that no usage reaches are not read again."""
    from cohortgrid.plans import align_queries, grid_queries, model_queries, survey_queries

    got = model_queries.target_rows(bound)
    read = {f.rsplit("/", 2)[1].rsplit("-", 1)[0] for f in got.inputFiles() if "target-" in f}
    assert read == {"target-usage", "target-responses"}
    responses = bound.spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles() if "target-responses" in f})
    assert 0 < responses.count() * 2 < bound.survey_response.where("survey_id IN (0, 1)").count()
    labelled = survey_queries.labels_of(bound).join(align_queries.phq9_of(bound).select("survey_response_id", "severity_label"), "survey_response_id", "left")
    targets = {name: (column, positive) for name, (column, positive, _) in rules.TARGETS.items()}
    wide = lookback.multiwindow_slots(timegrid.hourly_screentime(grid_queries.app_sessions_of(bound)), labelled, "hourly_screentime",
                                      model_queries.TARGET_WINDOWS, keep=[c for c, _ in targets.values()])
    want = experiments.stacked(wide, targets, lambda w: [f"hour_{i}" for i in range(w)], model_queries.TARGET_WINDOWS, "survey_response_id")
    plain = lambda df: sorted((*r[:6], tuple(round(v, 6) for v in r.x)) for r in df.select("target", "window_hours", "survey_response_id", "user", "label", "ts", "x").collect())
    assert plain(got) == plain(want)
