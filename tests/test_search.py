"""Staged evaluation of forests and boosted trees."""

import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortgrid.operators import mlprep, models
from cohortgrid.session import materialize, release

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, float((i * 7) % 11 + i % 3 > 6), float((i * 7) % 11), float((i * 5) % 13), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double, fold int")
    return mlprep.with_class_weight(df).coalesce(1).cache()


def scores(model, rows):
    return [tuple(r) for r in models.score_frame(model.transform(models.assemble(rows, COLUMNS)), "id").orderBy("id").collect()]


def test_first_rounds_are_the_shorter_fit(train):
    """A boosted model's first trees are those of a fit with fewer rounds."""
    fit = lambda n: models.make_model("gbt", maxIter=n, maxDepth=2).fit(models.assemble(train, COLUMNS))
    long = fit(6)
    assert scores(models.first_trees("gbt", long, 3), train) == scores(fit(3), train)
    assert scores(models.first_trees("gbt", long, 6), train) == scores(long, train)


def test_first_trees_of_a_forest_vote(train):
    forest = models.make_model("rf", numTrees=5, maxDepth=3).fit(models.assemble(train, COLUMNS))
    cut = models.first_trees("rf", forest, 2)
    assert len(cut.trees) == 2 and cut.trees[0].toDebugString == forest.trees[0].toDebugString
    alone = [scores(t, train) for t in cut.trees]
    for both, one, two in zip(scores(cut, train), *alone):
        assert both[3] == pytest.approx((one[3] + two[3]) / 2)


@pytest.mark.parametrize("name,space", [("rf", {"numTrees": [2, 4], "maxDepth": [1, 3]}), ("gbt", {"maxIter": [1, 3], "maxDepth": [2], "stepSize": [0.1, 0.5]})])
def test_search_fits_once_for_points_that_share_trees(train, monkeypatch, name, space):
    made, make = [], models.make_model

    def counted(*args, **params):
        made.append(params)
        return make(*args, **params)

    monkeypatch.setattr(models, "make_model", counted)
    whole = {"subsamplingRate": 1.0, "featureSubsetStrategy": "all"} if name == "gbt" else {}  # no draws by row order
    table, best, model = models.staged_search(name, COLUMNS, train, "fold", 2, space=space, **whole)
    assert len(table) == 4 and len(made) == 2 * 2 + 1  # two shared points, two folds, the refit
    assert best in [p for p, _ in table] and dict(next(t for t in table if t[0] == best)[0]) == best
    assert max(r for _, r in table) == next(r for p, r in table if p == best)
    for point, recall in table:  # each point as fitted by itself, where that is the same model
        if name == "gbt":
            alone = []
            for fold in (0, 1):
                m = make(name, **(whole | point)).fit(models.assemble(train.where(F.col("fold") != fold), COLUMNS))
                alone.append(models.SafeRecall().evaluate(m.transform(models.assemble(train.where(F.col("fold") == fold), COLUMNS))))
            assert recall == pytest.approx(sum(alone) / 2)


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(i, i % 10, float(i % 2), float(i % 2) * 3 + (i % 5) * 0.1, float((i * 37) % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, app_user_id long, label double, a double, b double")
    return mlprep.split_stratified(df, "id", "label").cache()


@pytest.mark.parametrize("name,params", [("rf", {"numTrees": 5}), ("gbt", {"maxIter": 5}), ("mlp", {"maxIter": 40})])
def test_models_learn_a_separable_label(separable, name, params):
    scored = models.fit_predict(name, separable, "id", COLUMNS, scaled=name == "mlp", **params).collect()
    assert {r.id for r in scored} == {r.id for r in separable.where("is_test").collect()}
    assert all(r.y_true == r.y_pred and (r.score > 0.5) == (r.y_pred == 1) for r in scored)


def test_importance_goes_to_the_column_that_tells(spark, separable):
    fitted = models.make_model("rf", numTrees=5).fit(models.assemble(mlprep.with_class_weight(separable), COLUMNS))
    got = models.feature_importances(fitted, COLUMNS, spark, 1).collect()
    assert [r.feature for r in got] == ["a"] and got[0].share > 0.9


def test_hashed_features_by_value(spark):
    df = spark.createDataFrame([(1, "x", "u"), (2, "x", "v"), (3, "y", "u"), (4, None, "u")], "id int, p string, q string")
    got = {r.id: r.hashed for r in mlprep.hash_features(df, ["p", "q"]).collect()}
    assert all(v.size == mlprep.HASH_BUCKETS for v in got.values())
    assert got[1].dot(got[2]) == 1 and got[1].dot(got[3]) == 1 and got[2].dot(got[3]) == 0 and got[4].numNonzeros() <= 2


def test_fits_run_as_many_tasks_as_their_rows_fill(spark):
    """Few rows go to one task whatever the cluster's shuffle has; many rows to more."""
    few = spark.range(0, 2000, 1, 24).select("id", F.lit(0.5).alias("a"))
    assert models.dealt(few, 48, "id").rdd.getNumPartitions() == 1
    assert models.dealt(few, 48 * 1000).rdd.getNumPartitions() == -(-2000 * 48_000 * 8 // models.TASK_BYTES)
    assert models.dealt(few.limit(0), 48).rdd.getNumPartitions() == 1


def test_tables_by_column_are_read_by_folder_and_released(spark):
    rows = spark.range(100).select("id", F.concat(F.lit("0"), (F.col("id") % 3).cast("string")).alias("k"))
    table = materialize(rows, "by", by="k")
    assert table.where("k = '01'").count() == 33 and dict(table.dtypes) == dict(rows.dtypes)
    plan = table.where("k = '01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan
    folder = table.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    release(table)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("name,params", [("rf", {"numTrees": 5}), ("gbt", {"maxIter": 5})])
def test_a_fit_does_not_wrap_its_trees(train, name, params):
    """Wrapping each tree takes calls to the JVM that concurrent fits make one after another."""
    model = models.make_model(name, maxDepth=2, **params).fit(models.assemble(train, COLUMNS))
    for held in (model, models.first_trees(name, model, 2)):
        assert "trees" not in vars(held)
    assert [t.toDebugString for t in models.first_trees(name, model, 2).trees] == [t.toDebugString for t in model.trees[:2]]


def test_remembered_nodes_give_the_same_forest(train):
    fit = lambda **more: models.make_model("rf", numTrees=20, maxDepth=6, **more).fit(models.assemble(train, COLUMNS))
    held, walked = fit(), fit(cacheNodeIds=False)
    assert held.getCacheNodeIds() and held.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_recalls_of_several_predictions_in_one_pass(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], "label double, p double, q double")
    assert models.SafeRecall.of("label", ["p", "q"], rows) == [0.5, 0.0]
    assert models.SafeRecall.of("label", ["p"], rows.where("label = 1")) == [0.0]


def test_trees_grow_in_tasks_of_many_rows(spark, monkeypatch):
    """Statistics of the open nodes are made, sent and merged once for each task: by rows, and by bytes where rows are wide."""
    rows = spark.range(0, 40_000, 1, 4)
    assert models.dealt(rows, 48, "id").rdd.getNumPartitions() == 4
    assert models.dealt_trees(rows, 48, "id").rdd.getNumPartitions() == 2
    assert models.dealt_trees(rows, 1000).rdd.getNumPartitions() == -(-40_000 * 8000 // models.TREE_BYTES)
    assert models.dealt_trees(rows.limit(0), 48).rdd.getNumPartitions() == 1
    dealt, seen = models.dealt_trees, []

    def spied(df, width, key=None):
        seen.append(dealt(df, width, key))
        return seen[-1]

    monkeypatch.setattr(models, "dealt_trees", spied)
    table = rows.select("id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5 == 0).alias("is_test"))
    assert models.fit_predict("gbt", table, "id", ["a"], scaled=False, maxIter=1, maxDepth=1).count() == 8000
    assert [t.count() for t in seen] == [32_000]


def test_numbers_that_are_not_zero_grow_the_same_forest(spark):
    rows = spark.range(300).select("id", (F.col("id") * 7 % 11 > 5).cast("double").alias("label"), F.expr(
        "transform(sequence(0, 11), i -> IF((id * 5 + i) % 9 = 0, cast(id % 13 + i AS double), 0D))").alias("a")).coalesce(1)
    dense = rows.select("id", "label", array_to_vector("a").alias("x"))
    few = models.compressed(dense, 12)
    assert few.columns == ["id", "label", "features"] and {type(r.features).__name__ for r in few.collect()} == {"SparseVector"}
    assert [list(r.features.toArray()) for r in few.orderBy("id").collect()] == [r.a for r in rows.orderBy("id").collect()]
    grown = [models.make_model("rf", weighted=False, numTrees=10).fit(t).toDebugString.split("\n")[1:]
             for t in (dense.withColumnRenamed("x", "features"), few)]
    assert grown[0] == grown[1] and len(grown[0]) > 20


def test_forests_wait_for_room(spark):
    """As many side by side as fit; one larger than all of it alone, and none for ever."""
    room = models.Room(spark)
    assert room.left == room.all > 0
    rows, most, now = room.all // (4 * 13), [0], [0]  # one column and four trees: each takes all

    def grow(share):
        with room.taken(rows // share, 1, 4):
            now[0] += 1
            most[0] = max(most[0], now[0])
            time.sleep(0.05)
            now[0] -= 1

    for share, side_by_side in ((1, 1), (3, 3)):
        most[0] = 0
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(grow, [share] * 8))
        assert most[0] == side_by_side
    with room.taken(rows * 50, 1, 4):
        assert room.left == 0
    assert room.left == room.all
