"""Distributed classifiers, user-grouped evaluation and tuning."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial, reduce
from itertools import product
from threading import Condition

from pyspark import SparkContext, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, shared_dir
from . import newton
from .mlprep import fit_scaler, fold_report, fold_validity, scale, user_folds, with_class_weight

SEED = 42

# Bytes of features that a task of an iterative fit holds; a forest's task runs all trees over them in every round.
TASK_BYTES = 4 * 1024 * 1024
FOREST_BYTES = 512 * 1024
# Rows and bytes of features of a task that grows trees. In each round a task makes, sends and merges the statistics of
# all open nodes, which cost what a few ten thousand rows do, however few rows it holds.
TREE_ROWS = 32 * 1024
TREE_BYTES = 64 * 1024 * 1024


class Forest(RandomForestClassificationModel):
    """A fitted forest whose ``trees`` are wrapped when they are read. The library's constructor reads its cached
    property, which makes some thousand calls to the JVM for each hundred trees, one fit at a time."""

    trees = property(RandomForestClassificationModel.trees.func)


class Boosted(GBTClassificationModel):
    """As ``Forest``, for boosted trees."""

    trees = property(GBTClassificationModel.trees.func)


class ForestClassifier(RandomForestClassifier):
    def _create_model(self, java_model) -> Forest:
        return Forest(java_model)


class BoostedClassifier(GBTClassifier):
    def _create_model(self, java_model) -> Boosted:
        return Boosted(java_model)


def make_model(name: str, n_features: int = 0, weighted: bool = True, **params) -> Estimator:
    """An estimator by name: lr, rf, gbt or mlp. ``params`` override its settings."""
    weight = {"weightCol": "weight"} if weighted else {}
    if name == "lr":
        return LogisticRegression(**({"maxIter": 100, "regParam": 0.01, "standardization": False} | weight | params))
    if name == "rf":
        # Rows remember the node that they reached: the same trees, and no round walks every tree from its root.
        return ForestClassifier(**({"numTrees": 100, "maxDepth": 10, "cacheNodeIds": True, "seed": SEED} | weight | params))
    if name == "gbt":
        base = {
            "maxDepth": 5, "maxIter": 600, "stepSize": 0.05, "subsamplingRate": 0.8,
            "featureSubsetStrategy": "0.8", "minInstancesPerNode": 1, "minInfoGain": 0.0, "seed": SEED,
        }
        return BoostedClassifier(**(base | weight | params))
    if name == "mlp":
        return MultilayerPerceptronClassifier(**({"layers": [n_features, 128, 64, 2], "maxIter": 100, "seed": SEED} | params))
    raise ValueError(f"unknown model {name!r}; use lr, rf, gbt or mlp")


def model_map(custom: dict[str, Estimator] | None, n_features: int, weighted: bool = True) -> dict[str, Estimator]:
    """The caller's estimators, else the two default classifiers."""
    if custom:
        return custom
    return {m: make_model(m, n_features, weighted) for m in ("lr", "rf")}


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def compressed(df: DataFrame, width: int, column: str = "x") -> DataFrame:
    """``features``: the vector ``column`` by the numbers that are not 0 where that is shorter."""
    sized = VectorSizeHint(inputCol=column, size=width, handleInvalid="optimistic").transform(df)
    return VectorAssembler(inputCols=[column], outputCol="features", handleInvalid="keep").transform(sized).drop(column)


def dealt(rows: DataFrame, width: int, key: str | None = None, size: int = TASK_BYTES) -> DataFrame:
    """``rows`` in as many partitions as their features' size asks for, not as many as the cluster has for a shuffle:
    a fit of many rounds over few rows runs some ten thousand stages, and each has a task for every partition.
    By ``key``, a seeded fit also draws the same rows wherever it runs. Counts the rows: meant for written tables."""
    parts = max(1, -(-rows.count() * width * 8 // size))
    return rows.repartition(parts, key).sortWithinPartitions(key) if key else rows.repartition(parts)


def dealt_trees(rows: DataFrame, width: int, key: str | None = None) -> DataFrame:
    """``dealt`` for fits that grow trees over many rows: by ``TREE_ROWS``, and by ``TREE_BYTES`` where rows are wide."""
    return dealt(rows, width, key, min(TREE_BYTES, TREE_ROWS * width * 8))


class Room:
    """Bytes of the executors' memory for cached blocks, lent to forests that grow side by side. One that finds no room
    waits, so rows that each round reads are not written to disk and read back; one larger than all of it grows alone."""

    def __init__(self, spark):
        held, self.all = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator(), 0
        while held.hasNext():
            self.all += held.next()._1()
        self.left, self.changed = self.all, Condition()

    @contextmanager
    def taken(self, rows: int, width: int, trees: int):
        """Room for binned features, draws, and the nodes that rows are in before and after a round."""
        size = min(self.all, rows * 4 * (width + 3 * trees))
        with self.changed:
            self.changed.wait_for(lambda: self.left >= size)
            self.left -= size
        try:
            yield
        finally:
            with self.changed:
                self.left += size
                self.changed.notify_all()


def checkpointed(spark) -> None:
    """Boosting cuts the lineage of its errors every few rounds if the context has a checkpoint folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoints"))


def score_frame(predictions: DataFrame, key: str) -> DataFrame:
    """``key, y_true, y_pred, score`` with the positive class's probability."""
    return predictions.select(
        key,
        F.col("label").cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability").getItem(1).alias("score"),
    )


def fit_predict(name: str, split: DataFrame, key: str, columns: list[str], scaled: bool = True, **params) -> DataFrame:
    """Train on ``~is_test`` and score the test rows. Scaling is learnt on the training rows."""
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    if scaled:
        fitted = fit_scaler(train, columns)
        train, test = scale(train, fitted), scale(test, fitted)
    weighted = name != "mlp"
    train = with_class_weight(train) if weighted else train
    deal = dealt_trees if name == "gbt" else partial(dealt, size=FOREST_BYTES if name == "rf" else TASK_BYTES)
    rows = assemble(deal(train, len(columns), key), columns).select("label", "features", *(["weight"] if weighted else [])).persist()
    if name == "gbt":
        checkpointed(split.sparkSession)
    try:
        model = make_model(name, len(columns), weighted, **params).fit(rows)
    finally:
        rows.unpersist()
    return score_frame(model.transform(assemble(test, columns)), key)


def feature_importances(model, columns: list[str], spark, n: int = 20) -> DataFrame:
    """Largest ``n`` importances with their share of the total."""
    pairs = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    table = spark.createDataFrame(pairs, "feature string, importance double")
    total = table.agg(F.sum("importance")).scalar()
    return table.withColumn("share", F.col("importance") / total).orderBy(F.col("importance").desc(), "feature").limit(n)


def louo_predict(name: str, df: DataFrame, key: str, columns: list[str], scheme: str = "user", folds: int = 10,
                 parallelism: int = 4, **params) -> DataFrame:
    """User-grouped cross-validation scores, pooled over folds: each user left out (``scheme="user"``) or
    groups of users (``"grouped"``, ``folds`` of them).

    Logistic models of all folds are solved together (``newton.leave_one_out``). Other models train one
    distributed fit per fold, ``parallelism`` at a time; a fold's scores are written to the shared folder as it ends.
    Folds whose training rows lack a class are skipped, as one grouping over all folds tells.
    """
    if name == "lr" and set(params) <= {"regParam"}:
        return newton.leave_one_out(user_folds(df, scheme, folds), key, columns, "fold", reg=params.get("regParam", newton.REG))
    folded = materialize(user_folds(df, scheme, folds), "folds")
    valid = fold_validity(folded, train_only=True).where("usable").orderBy("fold")
    ids = [r.fold for r in valid.select("fold").collect()]
    if not ids:
        raise ValueError("no fold has both classes in its training rows")

    def run(fold: str) -> DataFrame:
        split = folded.withColumn("is_test", F.col("fold") == fold)
        return materialize(fit_predict(name, split, key, columns, **params).withColumn("fold", F.lit(fold)), "fold-scores")

    with ThreadPoolExecutor(parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(df.sparkSession)(run), ids))


class SafeRecall(Evaluator, HasLabelCol, HasPredictionCol):
    """Recall of the positive class; 0 on a slice with one class only."""

    @staticmethod
    def of(label: str, predictions: list[str], dataset: DataFrame) -> list[float]:
        """The recall of each prediction column, in one pass."""
        truth = F.col(label) == 1
        hits = [F.count_if(truth & (F.col(p) == 1)) for p in predictions]
        *tp, p, q = dataset.agg(*hits, F.count_if(truth), F.count_if(~truth)).first()
        return [n / p if p and q else 0.0 for n in tp]

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        return self.of(self.getLabelCol(), [self.getPredictionCol()], dataset)[0]

    def isLargerBetter(self) -> bool:
        return True


# Search spaces of the tuned models, by parameter.
SPACES: dict[str, dict[str, list]] = {
    "lr": {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "rf": {"numTrees": [100, 200, 300], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4]},
    "gbt": {"maxIter": [100, 300, 600], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.05, 0.1]},
}


def random_search(name: str, columns: list[str], train: DataFrame, fold_col: str, folds: int, draws: int = 20,
                  seed: int = SEED, parallelism: int = 4, space: dict[str, list] | None = None, **params):
    """Seeded random draw of the parameter grid, cross-validated on given folds of the training rows with safe
    recall. Scaling is a stage of the pipeline, so each fold learns it from its own training part; the best
    parameters are refit on all training rows."""
    model = make_model(name, len(columns), **params)
    raw = VectorAssembler(inputCols=columns, outputCol="raw" if name == "lr" else "features", handleInvalid="keep")
    stages = [raw, StandardScaler(inputCol="raw", outputCol="features", withMean=True), model] if name == "lr" else [raw, model]
    builder = ParamGridBuilder()
    for param, values in (space or SPACES[name]).items():
        builder = builder.addGrid(model.getParam(param), values)
    grid = builder.build()
    chosen = random.Random(seed).sample(grid, min(draws, len(grid)))
    search = CrossValidator(
        estimator=Pipeline(stages=stages), estimatorParamMaps=chosen, evaluator=SafeRecall(), numFolds=folds,
        foldCol=fold_col, parallelism=parallelism, seed=seed,
    )
    return search.fit(train)


# The parameter that counts a model's trees: a model with more holds those with fewer.
COUNTED = {"rf": "numTrees", "gbt": "maxIter"}


def first_trees(name: str, model, n: int):
    """The model of a fitted forest's or boosted model's first ``n`` trees."""
    kinds, held = SparkContext._active_spark_context._jvm.org.apache.spark.ml.classification, model._java_obj
    trees = held.trees()[:n]
    if name == "rf":
        return Forest(kinds.RandomForestClassificationModel(held.uid(), trees, held.numFeatures(), held.numClasses()))
    weights = held.treeWeights()[:n]
    return Boosted(kinds.GBTClassificationModel(held.uid(), trees, weights, held.numFeatures(), held.numClasses()))


def staged_search(name: str, columns: list[str], train: DataFrame, fold_col: str, folds: int, draws: int = 20, seed: int = SEED,
                  parallelism: int = 4, space: dict[str, list] | None = None, **params):
    """Seeded random draw of a forest's or boosted model's grid, cross-validated on given folds with safe recall.

    Points that differ only in how many trees they have share one fit for each fold: the one with the most trees,
    whose first trees are scored for the others. Returns ``([(point, mean recall)], best point, model)`` with the best
    point refitted on all training rows; earlier draws win ties."""
    space, counted = space or SPACES[name], COUNTED[name]
    points = [dict(zip(space, values)) for values in product(*space.values())]
    chosen = random.Random(seed).sample(points, min(draws, len(points)))
    shared: dict[tuple, set[int]] = {}
    for point in chosen:
        shared.setdefault(tuple((k, v) for k, v in point.items() if k != counted), set()).add(point[counted])
    rows = materialize(dealt_trees(assemble(train, columns).select("label", "features", "weight", fold_col), len(columns)), "search")
    if name == "gbt":
        checkpointed(train.sparkSession)

    own = {fold: dealt_trees(rows.where(F.col(fold_col) != fold), len(columns)).persist() for fold in range(folds)}
    room, size = Room(train.sparkSession), rows.count()

    def run(task: tuple[tuple, int]) -> list[tuple[tuple, int, float]]:
        rest, fold = task
        counts = sorted(shared[rest])
        with room.taken(size, len(columns), counts[-1] if name == "rf" else 1):
            model = make_model(name, len(columns), **(params | dict(rest) | {counted: counts[-1]})).fit(own[fold])
        scored = rows.where(F.col(fold_col) == fold).select("label", "features")
        for n in counts:
            part = model if n == counts[-1] else first_trees(name, model, n)
            part.setRawPredictionCol("").setProbabilityCol("").setPredictionCol(f"p{n}")
            scored = part.transform(scored)
        return [(rest, n, recall) for n, recall in zip(counts, SafeRecall.of("label", [f"p{n}" for n in counts], scored))]

    # The slowest fits first, so that none is left alone at the end.
    tasks = sorted(((rest, f) for rest in shared for f in range(folds)), key=lambda t: (-dict(t[0]).get("maxDepth", 0), -max(shared[t[0]])))
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            done = list(pool.map(inheritable_thread_target(train.sparkSession)(run), tasks))
    finally:
        for part in own.values():
            part.unpersist()
    recalls: dict[tuple, list[float]] = {}
    for rest, n, recall in (r for part in done for r in part):
        recalls.setdefault((rest, n), []).append(recall)
    table = []
    for point in chosen:
        found = recalls[(tuple((k, v) for k, v in point.items() if k != counted), point[counted])]
        table.append((point, sum(found) / len(found)))
    best = max(table, key=lambda t: t[1])[0]
    model = make_model(name, len(columns), **(params | best)).fit(rows)
    release(rows)
    return table, best, model


__all__ = [
    "SafeRecall", "assemble", "feature_importances", "fit_predict", "fold_report", "louo_predict",
    "first_trees", "make_model", "model_map", "random_search", "score_frame", "staged_search", "Pipeline",
]
