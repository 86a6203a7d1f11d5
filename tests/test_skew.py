"""Chunked operators against plain ones, with one group holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortgrid.operators import fill, metrics, mlprep
from cohortgrid.operators import skew
from cohortgrid.operators.skew import chunked_row_number, exact_median, hot_keys, hot_row_number, with_quantile_chunk


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    users = [1] * 400 + [rng.randint(2, 60) for _ in range(600)]
    data = [(i, u, rng.choice(["at_risk"] + ["not_at_risk"] * 3), round(rng.random() ** 4, 3)) for i, u in enumerate(users)]
    return spark.createDataFrame(data, "id long, app_user_id long, risk_label string, score double").persist()


def test_hot_keys_are_few(skewed):
    assert [r[0] for r in hot_keys(skewed, ["app_user_id"], min_rows=100).collect()] == [1]
    assert hot_keys(skewed, ["app_user_id"]).count() == 0


@pytest.mark.parametrize("min_rows", [1_000_000, 100, 1])
def test_positions_do_not_depend_on_chunks(skewed, min_rows):
    key = mlprep.shuffle_key("id")
    rows = skewed.withColumn("h", key)
    got = hot_row_number(rows, ["app_user_id"], F.substring("h", 1, 1), [F.col("h"), F.col("id")], min_rows=min_rows)
    w = Window.partitionBy("app_user_id")
    plain = rows.withColumn("rn", F.row_number().over(w.orderBy("h", "id"))).withColumn("n", F.count("*").over(w))
    assert got.select("id", "rn", "n").exceptAll(plain.select("id", F.col("rn").cast("long"), "n")).count() == 0
    assert got.count() == skewed.count()


def test_chunked_positions_without_keys(skewed):
    placed = chunked_row_number(with_quantile_chunk(skewed, "score"), [], [F.col("score"), F.col("id")])
    ordered = [r.id for r in placed.orderBy("rn").collect()]
    assert ordered == [r.id for r in skewed.orderBy("score", "id").collect()]


def test_user_split_is_the_same_for_hot_users(skewed):
    plain = mlprep.split_by_user(skewed, "id", "risk_label").select("id", "is_test")
    hot = mlprep.split_by_user(skewed, "id", "risk_label", min_rows=50).select("id", "is_test")
    assert plain.exceptAll(hot).count() == 0
    assert plain.count() == 1000
    sides = mlprep.split_by_user(skewed, "id", "risk_label").groupBy("app_user_id").agg(
        F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert sides.where("n > 1 AND (t = 0 OR t = n)").count() == 0


def test_stratified_split_sizes(skewed):
    got = mlprep.split_stratified(skewed, "id", "risk_label").groupBy("risk_label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    for r in got:
        assert r.t == -(-3 * r.n // 10)


def test_auc_equals_pair_counting(skewed):
    rows = skewed.select((F.col("risk_label") == "at_risk").cast("int").alias("y_true"), "score").collect()
    pos, neg = [r.score for r in rows if r.y_true], [r.score for r in rows if not r.y_true]
    expected = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    scored = skewed.withColumn("y_true", (F.col("risk_label") == "at_risk").cast("int"))
    assert metrics.roc_auc(scored, []).first().auc == pytest.approx(expected)


def test_exact_median_narrows_to_the_value(skewed, monkeypatch):
    values = sorted(r.score for r in skewed.collect())
    expected = (values[499] + values[500]) / 2
    assert exact_median(skewed, "score") == pytest.approx(expected)
    monkeypatch.setattr(skew, "WHOLE_GROUP", 10)
    assert exact_median(skewed, "score") == pytest.approx(expected)
    assert exact_median(skewed.where("id < 0"), "score") is None


def test_medians_of_all_groups_and_columns(spark):
    """One group holds nearly all rows; others have one, two, or only missing values."""
    hot = spark.range(100_001).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 100_003).cast("double").alias("a"),
                                      F.when(F.col("id") % 4 > 0, F.col("id") % 11).cast("double").alias("b"))
    few = spark.createDataFrame([("one", 5.0, None), ("two", 1.0, 2.0), ("two", 4.0, 2.5), ("none", None, None)], "k string, a double, b double")
    rows = hot.unionByName(few).repartition(6)
    got = {r.k: (r.a, r.b) for r in skew.exact_medians(rows, ["k"], ["a", "b"]).collect()}
    want = {r.k: (r.a, r.b) for r in rows.groupBy("k").agg(F.median("a").alias("a"), F.median("b").alias("b")).where("k <> 'none'").collect()}
    assert got == want
    plan = skew.exact_medians(rows, ["k"], ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in plan.replace("exact_median", "") and "collect_list" not in plan


def test_median_imputer(spark):
    df = spark.createDataFrame([(1.0,), (None,), (9.0,), (4.0,)], "v double")
    assert sorted(r.v for r in fill.impute(df, ["v"], "median").collect()) == [1.0, 4.0, 4.0, 9.0]


def test_resample_balances_classes(skewed):
    rows = skewed.withColumn("label", (F.col("risk_label") == "at_risk").cast("double"))
    once = mlprep.weighted_resample(rows, "id")
    counts = {r.label: r["count"] for r in once.groupBy("label").count().collect()}
    assert abs(counts[0.0] - 500) < 90 and abs(counts[1.0] - 500) < 90
    again = mlprep.weighted_resample(rows.repartition(5), "id")
    assert once.exceptAll(again).count() == 0


def test_folds_partition_the_rows(skewed):
    folded = mlprep.stratified_folds(skewed, "id", "risk_label")
    sizes = [r["count"] for r in folded.groupBy("risk_label", "fold").count().collect()]
    assert sum(sizes) == 1000 and folded.where("fold IS NULL").count() == 0
    few = skewed.where("risk_label = 'at_risk'")
    assert mlprep.stratified_folds(few, "id", "risk_label").where("fold IS NOT NULL").count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "date", "long"])
def test_values_are_carried_across_chunks(spark, kind):
    """One key with most rows over many chunks, another whose first chunks know nothing."""
    order = {"timestamp": "timestamp_seconds(t * 5000)", "date": "date_add(DATE'2020-01-01', int(t))", "long": "t"}[kind]
    data = [(1, t, float(t) if t % 41 == 3 else None) for t in range(900)] + [(2, t, 5.0 if t == 700 else None) for t in range(0, 900, 50)]
    df = spark.createDataFrame(data, "k int, t long, v double").withColumn("at", F.expr(order)).repartition(5)
    for strategy, step in (("ffill", 1), ("bfill", -1)):
        want, last = {}, {}
        for k, t, v in sorted(data)[::step]:
            last[k] = v if v is not None else last.get(k)
            want[k, t] = last[k]
        got = fill.impute(df, ["v"], strategy, ["k"], "at")
        assert got.columns == df.columns
        assert {(r.k, r.t): r.v for r in got.collect()} == want


def test_busy_day_of_gap_repair(spark):
    """A day of one user with all rows: found in hours, and rows without a user stay as they are."""
    from cohortgrid.operators import clean

    rows = [(i, 1, i * 37, i * 37 + 20 + i % 3 * 200) for i in range(2000)] + [(5000, None, 10, 20), (5001, None, 15, 25)]
    df = spark.createDataFrame(rows, "id long, app_user_id int, s long, e long").select(
        "id", "app_user_id", *[F.expr(f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {c})").alias(n) for c, n in (("s", "start_time"), ("e", "end_time"))])
    got = {r.id: r for r in clean.repair_gaps(df).collect()}
    assert len(got) == len(rows) and got[5000].previous_end is None and got[5001].previous_end is None
    plain = {r.id: r for r in df.collect()}
    for i in range(1, 2000):
        before = plain[i - 1].end_time
        assert got[i].previous_end == before
        follows = (plain[i].start_time - before).total_seconds() <= 120
        assert got[i].start_time == (before if follows else plain[i].start_time)
