"""Learning-data preparation: features, labels, splits, folds, weights."""

from __future__ import annotations

from pyspark.ml.feature import FeatureHasher
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import feature_columns, split_by_type
from ..functions.rules import TARGETS
from .skew import HOT_MIN_ROWS, chunked_row_number, hot_row_number

HASH_BUCKETS = 128


def feature_matrix(df: DataFrame, keep: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Feature columns only: missing numbers 0, missing categories ``missing``."""
    cols = feature_columns(df, exclude=list(keep or []) + list(exclude or []))
    numeric, categorical = split_by_type(df, cols)
    out = df.select(*(keep or []), *numeric, *[F.col(c).cast("string").alias(c) for c in categorical])
    return out.na.fill(0, numeric).na.fill("missing", categorical)


def encode_label(df: DataFrame, target: str) -> DataFrame:
    """Binary ``label`` (1.0 for the positive class); NULL and ``N/A`` rows are removed."""
    if target not in TARGETS:
        raise ValueError(f"unknown target {target!r}")
    column, positive, _ = TARGETS[target]
    return encode_binary(df, column, positive)


def encode_binary(df: DataFrame, column: str, positive: str) -> DataFrame:
    kept = df.where(F.col(column).isNotNull() & (F.col(column) != "N/A"))
    return kept.withColumn("label", (F.col(column) == positive).cast("double"))


def one_hot(df: DataFrame, column: str, levels: list[str], drop_first: bool = False) -> DataFrame:
    """0/1 column per given level, named ``<column>_<level>``; use ``hash_features`` where levels are not known."""
    used = levels[1:] if drop_first else levels
    hot = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in used}
    return df.withColumns(hot).drop(column)


def hash_features(df: DataFrame, columns: list[str], buckets: int = HASH_BUCKETS, output: str = "hashed") -> DataFrame:
    """``column=value`` tokens hashed into a sparse vector."""
    return FeatureHasher(inputCols=columns, outputCol=output, numFeatures=buckets, categoricalCols=columns).transform(df)


def fit_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, from one pass over the training rows."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Centre and divide; a column without spread becomes 0."""
    def one(c: str, mean: float, std: float) -> Column:
        centred = F.col(c) - F.lit(mean)
        return centred / F.lit(std) if std else centred

    return df.withColumns({c: one(c, m, s) for c, (m, s) in fitted.items() if m is not None})


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (k * n_class)`` and the negative/positive ratio, one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    out = counts.withColumn("weight", total / (classes * F.col("rows")).cast("double"))
    negatives = counts.agg(F.sum(F.when(F.col(label) == 0, F.col("rows")))).scalar()
    positives = counts.agg(F.sum(F.when(F.col(label) == 1, F.col("rows")))).scalar()
    return out.withColumn("neg_pos_ratio", negatives / positives.cast("double"))


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Attach ``weight``; the weight table has one row per class."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)


def _hash01(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the row key."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 12), 16, 10)
    return digits.cast("double") / F.lit(float(16**12))


def weighted_resample(df: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """Resample with replacement to equal expected class mass.

    A row is repeated a Poisson number of times with its class rate
    ``n / (k * n_class)``. The rate is split into trials of rate at most 1,
    each drawn by inversion from a hash of row key and trial: no shuffle of
    rows, any rate, and the same draw on every retry.
    """
    weighted = with_class_weight(df, label)
    trials = weighted.withColumn("_trials", F.ceil("weight").cast("int")).withColumn(
        "_trial", F.explode(F.sequence(F.lit(1), F.col("_trials")))
    )
    u = _hash01(F.concat_ws("|", F.col(key), F.col("_trial")), seed)
    rate = F.col("weight") / F.col("_trials")
    # A rate of 1 exceeds 24 with probability below the hash's resolution.
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.when(u > acc["c"], i).otherwise(acc["k"]).alias("k"))

    times = F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, step, lambda acc: acc["k"])
    drawn = trials.withColumn("_times", times).where(F.col("_times") > 0)
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return drawn.drop("_times", "_trials", "_trial", "copy", "weight")


# ------------------------------------------------------------ splits and folds


def shuffle_key(key: str, seed: int = 42) -> Column:
    """Seeded pseudo-random order of rows: the hex MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def split_stratified(df: DataFrame, key: str, label: str, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the first ``ceil(test_size * n)`` rows of each class in seeded order.

    A class can hold most rows, so positions are counted over 4096 hash
    ranges instead of one ordering per class.
    """
    rows = df.withColumn("_h", shuffle_key(key, seed)).withColumn("_chunk", F.substring("_h", 1, 3))
    placed = chunked_row_number(rows, [label], [F.col("_h"), F.col(key)], "_rn", "_n")
    return placed.withColumn("is_test", F.col("_rn") <= F.ceil(F.lit(test_size) * F.col("_n"))).drop("_h", "_rn", "_n")


def split_by_user(df: DataFrame, key: str, label: str, test_size: float = 0.3, seed: int = 42,
                  min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Every user on both sides; stratified inside a user when each of the user's classes has two rows.

    A user with one row trains. Users with more than ``min_rows`` rows are split into hash ranges.
    """
    per_class = df.groupBy("app_user_id", label).agg(F.count(F.lit(1)).alias("_n"))
    users = per_class.groupBy("app_user_id").agg(
        F.sum("_n").alias("_user_n"), F.min("_n").alias("_smallest"), F.count(F.lit(1)).alias("_classes")
    )
    stratify = (F.col("_classes") > 1) & (F.col("_smallest") >= 2)
    rows = df.join(users, "app_user_id").withColumn("_stratum", F.when(stratify, F.col(label).cast("string")).otherwise(""))
    rows = rows.withColumn("_h", shuffle_key(key, seed))
    placed = hot_row_number(rows, ["app_user_id", "_stratum"], F.substring("_h", 1, 3), [F.col("_h"), F.col(key)],
                            "_rn", "_n", min_rows)
    test = (F.col("_user_n") > 1) & (F.col("_rn") <= F.ceil(F.lit(test_size) * F.col("_n")))
    return placed.withColumn("is_test", test).drop("_user_n", "_smallest", "_classes", "_stratum", "_h", "_rn", "_n")


def split_temporal(df: DataFrame, key: str, ts: str, test_size: float = 0.3,
                   min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Each user's earliest ``floor(n * (1 - test_size))`` rows train, at least one row on each side."""
    placed = hot_row_number(df, ["app_user_id"], F.to_date(ts), [F.col(ts), F.col(key)], "_rn", "_n", min_rows)
    cut = F.floor(F.col("_n") * F.lit(1 - test_size))
    cut = F.least(F.greatest(cut, F.lit(1)), F.col("_n") - 1)
    return placed.withColumn("is_test", (F.col("_n") > 1) & (F.col("_rn") > cut)).drop("_rn", "_n")


def user_folds(df: DataFrame, scheme: str = "user", folds: int = 10) -> DataFrame:
    """Add ``fold``: each user alone (``scheme="user"``: leave one user out), or users hashed into ``folds``
    groups (``scheme="grouped"``). The scheme is the caller's choice, whatever the number of users."""
    if scheme == "user":
        return df.withColumn("fold", F.col("app_user_id").cast("string"))
    if scheme != "grouped":
        raise ValueError(f"unknown scheme {scheme!r}; use user or grouped")
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col("app_user_id")), F.lit(folds)).cast("string"))


def fold_report(df: DataFrame, label: str = "label") -> DataFrame:
    """Per user fold: test rows and whether the remaining rows hold both classes."""
    per = df.groupBy("app_user_id").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"),
    )
    positives, negatives = per.agg(F.sum("_p")).scalar(), per.agg(F.sum("_q")).scalar()
    ok = (positives - F.col("_p") > 0) & (negatives - F.col("_q") > 0)
    return per.select("app_user_id", "test_rows", ok.alias("usable"))


def stratified_folds(df: DataFrame, key: str, label: str, preferred: int = 5, minimum: int = 2, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0-based), classes spread evenly over ``min(preferred, smallest class)`` folds.

    ``fold`` is NULL when fewer than ``minimum`` folds are feasible.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.agg(F.struct(F.min("n").alias("smallest"), F.count(F.lit(1)).alias("classes"))).scalar()
    k, classes = F.least(F.lit(preferred), sizes["smallest"]), sizes["classes"]
    rows = df.withColumn("_h", shuffle_key(key, seed)).withColumn("_chunk", F.substring("_h", 1, 3))
    placed = chunked_row_number(rows, [label], [F.col("_h"), F.col(key)], "_rn")
    fold = F.when((k >= minimum) & (classes > 1), F.pmod(F.col("_rn") - 1, k).cast("int"))
    return placed.withColumn("fold", fold).drop("_h", "_rn")


def fold_validity(folded: DataFrame, label: str = "label", train_only: bool = False) -> DataFrame:
    """Whether each fold's complement, and the fold itself unless ``train_only``, holds both classes."""
    per = folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q")
    )
    # One row per fold.
    positives, negatives = F.sum("_p").over(Window.partitionBy()), F.sum("_q").over(Window.partitionBy())
    ok = (positives > F.col("_p")) & (negatives > F.col("_q"))
    if not train_only:
        ok = ok & (F.col("_p") > 0) & (F.col("_q") > 0)
    return per.select("fold", "rows", ok.alias("usable"))


def validation_report(df: DataFrame, label: str, min_samples: int = 10, min_features: int = 1,
                      max_missing: float = 0.5, max_imbalance: float = 10.0) -> DataFrame:
    """Row count, missing share and class balance of a training set as flags, from one pass
    over the rows and one over the class counts."""
    cols = df.columns
    counts = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(cols)]
    )
    nulls = sum((F.sum(f"_null_{i}") for i in range(len(cols))), F.lit(0))
    known = F.when(F.col(label).isNotNull(), F.col("n"))
    stats = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), nulls.alias("_nulls"),
        F.count(known).alias("classes"), F.max(known).alias("_hi"), F.min(known).alias("_lo"),
    )
    missing = F.col("_nulls") / (F.col("rows") * len(cols))
    ratio = F.col("_hi") / F.col("_lo")
    return stats.select(
        "rows",
        F.lit(len(cols)).alias("columns"),
        missing.alias("missing_share"),
        "classes",
        ratio.alias("imbalance"),
        (F.col("rows") < min_samples).alias("too_few_rows"),
        F.lit(len(cols) < min_features).alias("too_few_columns"),
        F.coalesce(missing > max_missing, F.lit(False)).alias("many_missing"),
        (F.col("classes") < 2).alias("single_class"),
        ((F.col("classes") >= 2) & (ratio > max_imbalance)).alias("imbalanced"),
    )
