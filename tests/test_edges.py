"""Literal edge rows with answers worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortgrid.functions import parse, rules, taxonomy
from cohortgrid.functions.columns import feature_columns, timestamp_column, value_column
from cohortgrid.functions.timecols import strict_timestamp, week_start
from cohortgrid.operators import align, clean, fill, lookback, metrics, mlprep, reports, spines, surveys, timegrid


def ts(text):
    return dt.datetime.fromisoformat(text)


def listed(df, *cols, order=None):
    out = df.orderBy(*(order or cols)).select(*cols).collect()
    return [tuple(r) for r in out] if len(cols) > 1 else [r[0] for r in out]


DAY = "2025-11-19 "


def grid(rows, *data):
    return rows("app_user_id long, datetime ts, v double", *[(u, DAY + t, v) for u, t, v in data])


def test_asof_takes_first_survey_at_or_after(rows):
    left = grid(rows, (1, "08:00", 1.0), (1, "10:00", 2.0), (1, "12:00", 3.0), (2, "08:00", 4.0))
    right = rows("survey_response_id long, app_user_id long, survey_ts ts, label string",
                 (7, 1, DAY + "10:00", "a"), (8, 1, DAY + "11:30", "b"))
    got = align.next_survey(left, right)
    assert listed(got, "app_user_id", "v", "survey_response_id") == [(1, 1.0, 7), (1, 2.0, 7)]


def test_asof_looks_past_empty_days_and_breaks_ties_by_id(rows):
    left = rows("app_user_id long, datetime ts, v double", (1, "2025-01-01 08:00", 1.0), (1, "2025-01-03 09:00", 2.0))
    right = rows("survey_response_id long, app_user_id long, survey_ts ts, label string",
                 (9, 1, "2025-01-05 10:00", "x"), (4, 1, "2025-01-05 10:00", "y"), (5, 1, "2025-01-03 09:00", "z"))
    got = align.next_survey(left, right)
    assert listed(got, "v", "survey_response_id", "label") == [(1.0, 5, "z"), (2.0, 5, "z")]
    later = align.next_survey(left, right.where("survey_response_id <> 5"))
    assert listed(later, "v", "survey_response_id") == [(1.0, 4), (2.0, 4)]


def survey(rows, time, label="at_risk", sid=1):
    return rows("survey_response_id long, app_user_id long, survey_id int, survey_ts ts, risk_label string", (sid, 1, 0, DAY + time, label))


@pytest.mark.parametrize("mode, expected", [("rounded", (0.0, 8.0, 4.0)), ("elapsed", (8.0, 4.0, 2.0))])
def test_standard_slots(rows, mode, expected):
    hourly = grid(rows, *[(1, f"0{h}:00", float(v)) for h, v in ((5, 1), (6, 2), (7, 4), (8, 8), (9, 16))])
    got = lookback.lookback_slots(hourly, survey(rows, "14:37"), "v", 3, standardized=True, mode=mode)
    assert tuple(got.select("hour_0", "hour_1", "hour_2").first()) == expected
    assert got.first().ref_ts == ts(DAY + "09:00")


def test_actual_time_slots_round_half_to_even(rows):
    hourly = grid(rows, (1, "14:00", 1.0), (1, "13:00", 2.0), (1, "12:00", 4.0))
    got = lookback.lookback_slots(hourly, survey(rows, "14:30"), "v", 3)
    assert tuple(got.select("hour_0", "hour_1", "hour_2").first()) == (1.0, 0.0, 6.0)


def test_slots_without_rows_and_with_only_the_dropped_slot(rows):
    assert lookback.lookback_slots(grid(rows, (1, "20:00", 1.0)), survey(rows, "14:30"), "v", 3).count() == 0
    edge = grid(rows, (1, "06:00", 5.0))
    zero = lookback.lookback_slots(edge, survey(rows, "14:00"), "v", 3, standardized=True)
    assert tuple(zero.select("hour_0", "hour_1", "hour_2").first()) == (0.0, 0.0, 0.0)
    bare = lookback.lookback_slots(edge, survey(rows, "14:00"), "v", 3, standardized=True, fill=None)
    assert tuple(bare.select("hour_0", "hour_1", "hour_2").first()) == (None, None, None)


def test_slot_of_only_missing_values_is_zero(rows):
    got = lookback.lookback_slots(grid(rows, (1, "08:00", None)), survey(rows, "10:00"), "v", 3, standardized=True, fill=None)
    assert tuple(got.select("hour_0", "hour_1", "hour_2").first()) == (None, 0.0, None)


def sessions(rows, *data):
    schema = "app_user_id long, app_name string, app_category string, total_time_minutes double, last_time_used ts"
    return rows(schema, *[(1, a, c, m, t if "-" in t else DAY + t) for a, c, m, t in data])


@pytest.mark.parametrize("standardized, method", [(True, "pairs"), (False, "pairs"), (False, "prefix")])
def test_subwindow_edges(rows, standardized, method):
    used = sessions(rows, ("a", "X", 1.0, "09:00"), ("b", "Y", 2.0, "07:00"), ("c", "Z", 4.0, "05:00"))
    got = lookback.subwindow_features(used, survey(rows, "09:00"), 4, 2, standardized=standardized, method=method).first()
    assert (got.most_used_category_sw0, got.most_used_category_time_sw0, got.num_apps_sw0) == ("X", 1.0, 1)
    assert (got.most_used_category_sw1, got.most_used_category_time_sw1, got.num_apps_sw1) == ("Y", 2.0, 1)
    none = lookback.subwindow_features(used.where("app_user_id = 2"), survey(rows, "09:00"), 4, 2, standardized=standardized).first()
    assert (none.most_used_category_sw0, none.most_used_category_time_sw0, none.num_apps_sw0) == (None, 0.0, 0)


@pytest.mark.parametrize("method", ["pairs", "prefix"])
def test_category_windows_include_both_edges(rows, method):
    used = sessions(rows, ("a", "X", 1.0, "09:00"), ("b", "Y", 3.0, "08:00"), ("c", None, 5.0, "07:30"), ("d", "Z", 7.0, "09:00:00.000001"))
    refs = rows("screentime_id long, app_user_id long, ref_ts ts", (1, 1, DAY + "09:00"), (2, 2, DAY + "09:00"))
    got = {(r.screentime_id, r.window_hours): r for r in lookback.category_windows(used, refs, [1, 3], method).collect()}
    assert len(got) == 4
    one, three, empty = got[(1, 1)], got[(1, 3)], got[(2, 3)]
    assert (one.total_screentime, one.most_used_category, one.category_rank_2, one.num_apps_used) == (4.0, "Y", "X", 2)
    assert one.category_diversity == pytest.approx(0.811278, abs=1e-6)
    assert (three.total_screentime, three.num_categories_used, three.num_apps_used) == (9.0, 2, 3)
    assert three.most_used_category_proportion == pytest.approx(3 / 9)
    assert (empty.data_available, empty.total_screentime, empty.most_used_category) == (0, 0.0, None)
    assert empty.most_used_category_proportion is None


@pytest.mark.parametrize("method", ["pairs", "prefix"])
def test_category_windows_match_brute_force(spark, method):
    import random

    rng = random.Random(3)
    start = dt.datetime(2025, 1, 1)
    data = [(rng.choice([1, 1, 1, 2]), f"app{rng.randint(0, 5)}", rng.choice(["A", "B", None]), float(rng.randint(0, 9)),
             start + dt.timedelta(minutes=30 * rng.randint(0, 400))) for _ in range(300)]
    schema = "app_user_id long, app_name string, app_category string, total_time_minutes double, last_time_used timestamp_ntz"
    used = spark.createDataFrame(data, schema)
    times = [(i, u, t) for i, (u, _, _, _, t) in enumerate(data[:40])]
    refs = spark.createDataFrame(times, "screentime_id long, app_user_id long, ref_ts timestamp_ntz")
    got = {(r.screentime_id, r.window_hours): r for r in lookback.category_windows(used, refs, [1, 6, 24], method).collect()}
    for sid, user, t in times:
        for w in (1, 6, 24):
            inside = [d for d in data if d[0] == user and t - dt.timedelta(hours=w) <= d[4] <= t]
            r = got[(sid, w)]
            assert r.total_screentime == pytest.approx(sum(d[3] for d in inside))
            assert r.num_apps_used == len({d[1] for d in inside})
            assert r.num_categories_used == len({d[2] for d in inside if d[2]})
            assert r.data_available == int(bool(inside))


def test_methods_agree_to_the_last_digit(spark, rows):
    """A dense user with fractional minutes, ties between categories and windows that sum to zero."""
    import random

    rng = random.Random(5)
    data = []
    for k in range(600):
        t = f"2025-01-01 {rng.randint(0, 9):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}"
        data.append((f"app{k % 7}", "ABC"[k % 3], [0.1, 0.2, 0.3, 1 / 3, 0.0, 6351.046510025935][k % 6], t))
    data += [("zero", "A", 0.0, "2025-01-03 08:30:00"), ("zero2", "B", 0.0, "2025-01-03 08:40:00")]
    used = sessions(rows, *data)
    refs = rows("screentime_id long, app_user_id long, ref_ts ts", *[(h, 1, f"2025-01-01 {h:02d}:30:00") for h in range(1, 12)],
                (50, 1, "2025-01-03 09:00:00"), (51, 2, "2025-01-01 09:00:00"))
    pairs, prefix = (lookback.category_windows(used, refs, [1, 3, 6, 24], m) for m in ("pairs", "prefix"))
    assert pairs.count() == prefix.count() == 13 * 4
    assert pairs.exceptAll(prefix).count() == 0 and prefix.exceptAll(pairs.select(prefix.columns)).count() == 0
    with pytest.raises(ValueError):
        lookback.category_windows(used, refs, [1], "auto")


def test_subwindow_methods_agree(bound):
    pairs, prefix = (lookback.subwindow_features(bound.category_sessions, bound.surveys, 12, 3, standardized=False, method=m)
                     for m in ("pairs", "prefix"))
    assert pairs.count() == prefix.count() == bound.surveys.count()
    assert pairs.exceptAll(prefix).count() == 0


def test_weekly_mean_counts_missing_days_as_zero(rows):
    steps = rows("id long, app_user_id long, steps double, start_timestamp ts",
                 (1, 1, 10.0, "2025-11-19 08:00"), (2, 1, 20.0, "2025-11-24 08:00"), (3, 1, 30.0, "2025-11-25 08:00"))
    got = listed(timegrid.weekly_average(steps), "week_start", "avg_daily_steps")
    assert got == [(dt.date(2025, 11, 17), 2.0), (dt.date(2025, 11, 24), 25.0)]


def test_weekly_mean_keeps_empty_weeks(rows):
    steps = rows("id long, app_user_id long, steps double, start_timestamp ts",
                 (1, 1, 7.0, "2025-11-19 08:00"), (2, 1, 7.0, "2025-12-03 08:00"))
    got = listed(timegrid.weekly_average(steps), "week_start", "avg_daily_steps")
    assert got == [(dt.date(2025, 11, 17), 1.4), (dt.date(2025, 11, 24), 0.0), (dt.date(2025, 12, 1), pytest.approx(7 / 3))]


def test_week_anchors(spark):
    days = spark.createDataFrame([("2025-11-17",), ("2025-11-19",)], "d string").withColumn("d", F.col("d").cast("date"))
    assert listed(days, "d") and listed(days.select(week_start(F.col("d")).alias("w")), "w") == [dt.date(2025, 11, 17)] * 2
    assert listed(days.select(week_start(F.col("d"), "TUE").alias("w")), "w") == [dt.date(2025, 11, 11), dt.date(2025, 11, 18)]


@pytest.mark.parametrize("method, expected", [
    ("interpolate", [2, 2, 4, 6, 8, 8]), ("linear", [2, 2, 4, 6, 8, 8]), ("ffill_bfill", [2, 2, 2, 2, 8, 8]), ("zero", [0, 2, 0, 0, 8, 0])])
def test_fills(rows, method, expected):
    cells = [None, 2.0, None, None, 8.0, None]
    df = rows("app_user_id long, date int, v double", *[(1, i, c) for i, c in enumerate(cells)], (2, 0, None), (2, 1, None))
    got = fill.fill_gaps(df, ["v"], method, ["app_user_id"], "date")
    assert listed(got.where("app_user_id = 1"), "v", order=["date"]) == expected
    assert listed(got.where("app_user_id = 2"), "v") == ([0, 0] if method == "zero" else [None, None])


def test_unknown_fill_is_an_error(rows):
    with pytest.raises(ValueError):
        fill.fill_gaps(rows("app_user_id long, date int, v double", (1, 1, 1.0)), ["v"], "spline", ["app_user_id"], "date")


def test_gap_repair(rows):
    data = [(1, "10:00:00", "10:30:00"), (2, "10:31:30", "10:40:00"), (3, "10:50:00", "11:00:00"), (4, "10:55:00", "11:10:00")]
    parent = rows("id long, app_user_id long, start_time ts, end_time ts", *[(i, 1, DAY + a, DAY + b) for i, a, b in data])
    assert listed(clean.repair_gaps(parent), "start_time", order=["id"]) == [
        ts(DAY + t) for t in ("10:00:00", "10:30:00", "10:50:00", "11:00:00")]


def test_gap_repair_across_midnight_and_idle_days(rows):
    parent = rows("id long, app_user_id long, start_time ts, end_time ts",
                  (1, 1, "2025-01-01 23:00", "2025-01-01 23:59:30"), (2, 1, "2025-01-02 00:00:30", "2025-01-02 01:00"),
                  (3, 1, "2025-01-05 01:00", "2025-01-05 02:00"))
    got = clean.repair_gaps(parent)
    assert listed(got, "start_time", order=["id"]) == [ts("2025-01-01 23:00"), ts("2025-01-01 23:59:30"), ts("2025-01-05 01:00")]
    assert listed(got, "previous_end", order=["id"])[2] == ts("2025-01-02 01:00")


def test_first_session_repair(rows):
    schema = ("app_user_id long, screentime_id long, line int, app_name string, total_time_ms long, total_time_seconds double, "
              "calculated_start_time ts, start_time ts, last_time_used ts")
    row = (1, 1, 1, "a", 600_000, 600.0, DAY + "09:50", DAY + "09:55", DAY + "10:00")
    later = (1, 2, 1, "a", 60_000, 60.0, DAY + "10:59", DAY + "11:30", DAY + "11:00")
    got = clean.repair_first_session(rows(schema, row, later)).orderBy("screentime_id").collect()
    assert (got[0].calculated_start_time, got[0].last_time_used) == (ts(DAY + "10:00"), ts(DAY + "10:10"))
    assert got[1].calculated_start_time == ts(DAY + "10:59")
    kept = clean.repair_first_session(rows(schema, row), cutoff=DAY + "10:00").first()
    assert kept.calculated_start_time == ts(DAY + "09:50")


def test_app_sessions_shuffle_each_row_to_its_parent_and_to_its_repeats_only(spark):
    apps = spark.createDataFrame(
        [(1, 1, "a", 60_000, DAY + "10:00"), (1, 2, "b", 60_000, DAY + "10:00"), (2, 1, "a", 60_000, DAY + "10:00"),
         (3, 1, "a", 60_000, DAY + "10:00"), (4, 1, "launcher", 600_000, DAY + "09:00"), (5, 1, "a", 60_000, None),
         (9, 1, "x", 60_000, DAY + "10:00"), (None, 1, "x", 60_000, DAY + "10:00"), (6, 1, "a", 1, DAY + "12:00"), (6, 1, "a", 1, DAY + "12:00")],
        "screentime_id long, line int, app_name string, total_time_ms long, t string").selectExpr("*", "cast(t as timestamp_ntz) as last_time_used").drop("t")
    parents = spark.createDataFrame(
        [(1, 7, "10:00"), (2, 7, "10:00"), (3, 7, "11:00"), (4, 7, "12:00"), (5, 8, "10:00"), (6, None, "13:00"), (6, 9, "13:00"), (None, 7, "10:00")],
        "id long, app_user_id long, t string").selectExpr("id", "app_user_id", f"cast(concat('{DAY}', t) as timestamp_ntz) as start_time",
                                                         f"cast('{DAY}20:00' as timestamp_ntz) as end_time")
    got = clean.repaired_sessions(apps, parents)
    joined = clean.drop_excluded_apps(clean.drop_repeated_sessions(clean.join_parent(apps, parents)))
    timed = joined.withColumn("total_time_seconds", F.col("total_time_ms") / 1000.0).withColumn(
        "calculated_start_time", clean.add_seconds(F.col("last_time_used"), -F.col("total_time_seconds")))
    columns = ["app_user_id", "screentime_id", "line", "app_name", "start_time", "calculated_start_time", "last_time_used", "total_time_seconds"]
    want = clean.repair_first_session(timed)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert sorted((r.app_user_id, r.screentime_id, r.line) for r in got.where("was_first").collect()) == [(7, 1, 1), (9, 6, 1)]

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = clean.app_sessions(apps, parents)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "ReusedExchange" in plan  # the rows are dealt to their parents once for both readers


def test_dedup_keys(rows):
    df = rows("id long, app_user_id long, start ts", (1, 1, DAY + "08:00"), (2, 2, DAY + "08:00"))
    assert clean.dedup_start(df, "start").count() == 2
    assert listed(clean.dedup_start(df, "start", keys=["start"]), "id") == [1]


def test_strict_timestamps(spark):
    df = spark.createDataFrame([("2025-09-24 10:45:43.221",), ("2025-09-24 10:45:43",), ("x",)], "t string")
    assert [r[0] for r in df.select(strict_timestamp(F.col("t"))).collect()] == [ts("2025-09-24 10:45:43.221"), None, None]


def test_app_filter(rows):
    df = rows("app_name string", ("Foo.Launcher",), ("xcontroller",), (None,), ("maps",))
    assert listed(clean.drop_excluded_apps(df), "app_name") == [None, "maps"]


def test_categories(rows):
    df = rows("app_name string", ("com.ss.android.ugc.trill",), ("com.android.dialer",), ("com.android.settings",), ("zzz",), ("puzzler",), ("mystudy",))
    dim = rows("app_name string, app_category string", ("puzzler", "GAME_PUZZLE"))
    got = dict(listed(taxonomy.categorize_apps(df, dim, study_app="MyStudy"), "app_name", "app_category"))
    assert got == {"com.ss.android.ugc.trill": "SOCIAL", "com.android.dialer": "COMMUNICATION", "com.android.settings": "TOOLS",
                   "zzz": "UNKNOWN", "puzzler": "GAMES", "mystudy": "HEALTH_AND_FITNESS"}


@pytest.mark.parametrize("asleep, awake, hours", [
    ("11:23 pm", "7:05 am", 7.7), ("23:00", "06:30", 7.5), ("1:00 am", "1:00 am", 24.0), ("11 p.m.", "7 am", 8.0),
    ("1123pm", "7:05AM", 7.7), ("23:00:30", "23:30:30", 0.5), ("junk", "7 am", None), ("25:00", "7 am", None), (None, "7 am", None)])
def test_sleep_hours(spark, asleep, awake, hours):
    df = spark.createDataFrame([(asleep, awake)], "a string, b string")
    assert df.select(parse.sleep_hours(F.col("a"), F.col("b"))).first()[0] == hours


@pytest.mark.parametrize("hours, quality, label", [
    (5.0, None, "at_risk"), (11.0, None, "at_risk"), (8.0, 2, "at_risk"), (8.0, 3, "not_at_risk"), (None, None, None), (None, 3, "not_at_risk")])
def test_sleep_rule(spark, hours, quality, label):
    df = spark.createDataFrame([(hours, quality)], "h double, q int")
    assert df.select(rules.sleep_label(F.col("h"), F.col("q"))).first()[0] == label


@pytest.mark.parametrize("label, at, other", [
    ("positive_emotion_label", 5, 6), ("negative_emotion_label", 14, 13), ("social_stress_label", 6, 5),
    ("social_connection_label", 4, 5), ("minority_stress_label", 10, 9), ("emotion_regulation_label", 9, 8)])
def test_thresholds(spark, label, at, other):
    total = rules.THRESHOLDS[label][0]
    df = spark.createDataFrame([(at,), (other,), (None,)], f"{total} int")
    assert [r[0] for r in df.select(rules.threshold_label(label)).collect()] == ["at_risk", "not_at_risk", None]


def test_phq9_levels(spark):
    df = spark.createDataFrame([(v,) for v in (4, 5, 9, 10, 14, 15, 19, 20)], "t int")
    got = df.select(rules.phq9_severity(F.col("t")), rules.phq9_binary(F.col("t"))).collect()
    assert [r[0] for r in got] == ["minimal", "mild", "mild", "moderate", "moderate", "moderately_severe", "moderately_severe", "severe"]
    assert [r[1] for r in got] == ["not_depressed"] * 3 + ["depressed"] * 5


def test_totals(spark):
    df = spark.createDataFrame([(1, None, 2), (None, None, None)], "q21 int, q22 int, q37 int")
    assert [r[0] for r in df.select(rules.item_total([21, 22, 37])).collect()] == [3, None]
    phq = spark.createDataFrame([tuple([None] * 9)], ", ".join(f"q{i} int" for i in rules.PHQ9_ITEMS))
    assert phq.select(rules.phq9_total()).first()[0] == 0


def test_coercions(spark):
    df = spark.createDataFrame([("3", " Yes "), ("3.7", "F"), ("abc", "maybe"), (None, None), ("1d", "T"), ("-2.9", "0")], "n string, f string")
    got = df.select(parse.safe_int("n"), parse.yes_no("f")).collect()
    assert [tuple(r) for r in got] == [(3, 1), (3, 0), (None, None), (None, None), (None, 1), (-2, 0)]


def test_one_survey_per_day(rows):
    schema = "survey_response_id long, app_user_id long, survey_id int, survey_ts ts, {} string"
    data = [(1, 1, 1, DAY + "07:00", "at_risk"), (2, 1, 0, DAY + "08:00", "not_at_risk"), (3, 1, 1, DAY + "15:00", "N/A")]
    assert listed(surveys.one_per_day(rows(schema.format("sleep_label"), *data), "sleep_label"), "survey_response_id") == [2]
    assert listed(surveys.one_per_day(rows(schema.format("risk_label"), *data), "risk_label"), "survey_response_id") == [1]


def test_propagation(rows):
    df = rows("app_user_id long, risk_label string", (1, "at_risk"), (1, "not_at_risk"), (2, "not_at_risk"))
    got = surveys.propagate_positive(df, "risk_label", "at_risk")
    assert listed(got, "app_user_id", "risk_label") == [(1, "at_risk"), (1, "at_risk"), (2, "not_at_risk")]


@pytest.mark.parametrize("shares, expected", [([1.0, 1.0], 1.0), ([3.0, 1.0], 0.811278), ([5.0], 0.0), ([0.0, 0.0], 0.0)])
def test_entropy(spark, shares, expected):
    df = spark.createDataFrame([(shares,)], "s array<double>")
    assert df.select(lookback.normalized_entropy(F.col("s"))).first()[0] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("min_rows", [1_000_000, 1])
@pytest.mark.parametrize("n, train", [(1, 1), (2, 1), (3, 2), (10, 7), (90, 62)])
def test_temporal_split(spark, n, train, min_rows):
    base = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(i, 1, base + dt.timedelta(hours=7 * i)) for i in range(n)], "id long, app_user_id long, t timestamp_ntz")
    got = mlprep.split_temporal(df, "id", "t", min_rows=min_rows)
    assert listed(got.where(~F.col("is_test")), "id") == list(range(train))
    assert got.count() == n


def test_class_weights(rows):
    df = rows("label double", *[(0.0,)] * 8, *[(1.0,)] * 2)
    assert listed(mlprep.class_weights(df), "label", "weight", "neg_pos_ratio") == [(0.0, 0.625, 4.0), (1.0, 2.5, 4.0)]


def test_metrics(rows):
    pairs = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    m = metrics.classification_metrics(metrics.confusion(rows("y_true int, y_pred int", *pairs), [])).first()
    assert (m.accuracy, m.recall, m.specificity, m.balanced_accuracy) == (0.7, 0.6, 0.8, 0.7)
    assert m.f1 == pytest.approx(0.666667, abs=1e-6)


def test_auc_with_ties(rows):
    df = rows("y_true int, score double", (1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1))
    assert metrics.roc_auc(df, []).first().auc == 0.875


def test_ragged_mean(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0],)], "s array<double>")
    assert metrics.ragged_mean(df, [], "s").first()[0] == [2.0, 2.0, 3.0]


def test_sweep_pairs(spark):
    pairs = lookback.sweep_pairs(spark, 30)
    assert pairs.count() == 111
    assert sorted(listed(pairs.where("lookback_hours = 12"), "subwindow_hours")) == [1, 2, 3, 4, 6, 12]


def test_histogram_bins(rows):
    got = spines.histogram(rows("p double", (0.0,), (25.0,), (90.0,), (100.0,)), "p")
    assert listed(got, "bin", "users") == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 2)]


def test_three_users(rows):
    got = spines.three_users(rows("app_user_id long, total long", (1, 1), (2, 2), (3, 3), (4, 4)))
    assert listed(got, "role", "total") == [("least", 1), ("median", 3), ("most", 4)]


def test_value_and_timestamp_columns(rows):
    assert value_column(rows("app_user_id long, x double, steps int", (1, 1.0, 1))) == "steps"
    assert value_column(rows("app_user_id long, x double, speed double", (1, 1.0, 1.0)), weekly=True) == "x"
    assert value_column(rows("app_user_id long, a string", (1, "x"))) is None
    with pytest.raises(ValueError):
        value_column(rows("app_user_id long, a string", (1, "x")), weekly=True)
    assert timestamp_column(rows("timestamp string, created_at string", ("x", "2025-01-01 10:00:00"))) == "created_at"
    assert timestamp_column(rows("a string", ("x",))) is None
    assert feature_columns(rows("app_user_id long, hour_0 double, date ts, sleep_label string", (1, 1.0, DAY, "a"))) == ["hour_0"]


def test_user_filter_needs_the_column(rows):
    with pytest.raises(KeyError):
        clean.filter_user(rows("v double", (1.0,)), 5)


def test_date_ranges(bound):
    hourly = timegrid.hourly_health(bound.metric_events, date_range=("2024-01-05", "2024-01-06"))
    bounds = hourly.agg(F.min("datetime"), F.max("datetime")).first()
    assert ts("2024-01-05") <= bounds[0] and bounds[1] <= ts("2024-01-06")
    assert timegrid.hourly_health(bound.metric_events, date_range=("2030-01-01", "2030-02-01")).count() == 0


def test_cooccurrence(rows):
    base = [(1, "A", "08:00"), (1, "B", "09:00"), (1, "A", "10:00"), (1, "C", "11:00"), (2, "A", "08:00"), (2, "C", "08:00"), (3, "B", "08:00")]
    df = rows("app_user_id long, app_category string, last_time_used ts", *[(u, c, DAY + t) for u, c, t in base])
    assert listed(reports.category_cooccurrence(df), "category_1", "category_2", "count") == [("A", "B", 1), ("A", "C", 2), ("B", "C", 1)]


def test_mapping_keeps_unknown_users(rows):
    df, mapping = rows("app_user_id long", (1,), (2,)), rows("row_id long, app_user_id long, participant_id string", (1, 1, "old"), (2, 1, "new"))
    assert listed(align.map_participants(df, mapping), "app_user_id") == ["2", "new"]


def test_status_matrix_of_sparse_days_and_long_studies(rows):
    """Users of either input, more days than a word holds, days with nothing."""
    data = rows("app_user_id int, day int, n int", (1, 1, 1), (1, 64, 2), (1, 63, 0), (2, 130, 1))
    surveys = rows("app_user_id int, day int, n int", (1, 64, 1), (3, 126, 1), (3, 127, None))
    got = {(r.app_user_id, r.day): r.status for r in spines.status_matrix(data, surveys, "n", "n").collect()}
    want = {(u, d): "none" for u in (1, 2, 3) for d in range(1, 131)}
    want |= {(1, 1): "data", (1, 64): "both", (2, 130): "data", (3, 126): "survey"}
    assert got == want


def test_sweep_shuffles_a_surveys_usage_once(rows, bound):
    """Sizes are read from one list of a survey's usage: none of the thirty copies crosses a shuffle."""
    from cohortgrid.plans.align_queries import one_per_day_of

    pieces = lookback.sweep_pieces(bound.category_sessions, one_per_day_of(bound))
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline") < plan.index("Aggregate")
    sessions = rows("screentime_id int, app_user_id int, app_name string, app_category string, total_time_minutes double, last_time_used ts",
                    (1, 1, "x", "A", 2.0, "2024-01-02 08:30:00"), (2, 1, "y", "B", 2.0, "2024-01-02 08:10:00"), (3, 1, None, None, 9.0, "2024-01-02 07:30:00"))
    surveys = rows("survey_response_id int, app_user_id int, survey_ts ts", (5, 1, "2024-01-02 20:00:00"), (6, 2, "2024-01-02 20:00:00"))
    got = {(r.subwindow_hours, r.piece): (r._top and (r._top.category, r._top.minutes), r.num_apps) for r in lookback.sweep_pieces(sessions, surveys, 3).collect()}
    assert got == {(1, 0): (("A", 2.0), 2), (1, 1): (None, 0), (2, 0): (("A", 2.0), 2), (3, 0): (("A", 2.0), 2)}
    table = {(r.lookback_hours, r.subwindow_hours): (r.surveys_with_data, r.pieces_filled) for r in lookback.sweep_coverage(sessions, surveys, 3).collect()}
    assert table == {(1, 1): (1, 1), (2, 1): (1, 2), (2, 2): (1, 1), (3, 1): (1, 2), (3, 3): (1, 1)}


def test_window_figures_that_nobody_reads_are_not_made(spark):
    from cohortgrid.plans import QUERIES

    plan = QUERIES["feature_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "array_distinct" not in plan
