"""Classification metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import keep_first
from .skew import chunked_cumulative, with_quantile_chunk


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, keys: list[str], truth: str = "y_true", pred: str = "y_pred", times: str | None = None) -> DataFrame:
    """The four counts; ``times``: a column that tells how many rows a row stands for."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    count = F.count_if if times is None else lambda c: F.coalesce(F.sum(F.when(c, F.col(times))), F.lit(0)).cast("long")
    return df.groupBy(*keys).agg(
        count(t & p).alias("tp"),
        count(~t & p).alias("fp"),
        count(t & ~p).alias("fn"),
        count(~t & ~p).alias("tn"),
    )


def classification_metrics(counts: DataFrame) -> DataFrame:
    """All binary metrics from confusion counts; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    npv, specificity = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1, f1_neg = _safe_div(2 * tp, 2 * tp + fp + fn), _safe_div(2 * tn, 2 * tn + fp + fn)
    return counts.withColumns(
        {
            "support_positive": tp + fn,
            "support_negative": tn + fp,
            "accuracy": _safe_div(tp + tn, n),
            "precision": precision,
            "recall": recall,
            "f1": f1,
            "specificity": specificity,
            "precision_negative": npv,
            "recall_negative": specificity,
            "f1_negative": f1_neg,
            "f1_weighted": _safe_div(f1 * (tp + fn) + f1_neg * (tn + fp), n),
            "balanced_accuracy": (recall + specificity) / 2,
        }
    )


def roc_points(df: DataFrame, keys: list[str], truth: str = "y_true", score: str = "score") -> DataFrame:
    """ROC curve: cumulative counts at each distinct score, highest first.

    Equal scores collapse before any ordering, and running counts are summed
    in score-quantile chunks.
    """
    hits = df.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    chunked = with_quantile_chunk(hits, "threshold", descending=True)
    running = chunked_cumulative(chunked, keys, [F.col("threshold").desc()], {"pos": "tp", "neg": "fp"})
    totals = hits.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    out = running.join(totals, keys) if keys else running.withColumns(
        {"positives": totals.select("positives").scalar(), "negatives": totals.select("negatives").scalar()}
    )
    return out.withColumns(
        {"tpr": _safe_div(F.col("tp"), F.col("positives")), "fpr": _safe_div(F.col("fp"), F.col("negatives"))}
    )


def roc_auc(df: DataFrame, keys: list[str], truth: str = "y_true", score: str = "score") -> DataFrame:
    """Area under the curve: pairs ranked correctly, ties counting one half.

    NULL when a class is absent.
    """
    points = roc_points(df, keys, truth, score)
    # Positives above or level with the threshold are counted against its negatives.
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    pairs = F.max("positives").cast("double") * F.max("negatives").cast("double")
    return points.groupBy(*keys).agg(F.when(pairs > 0, won / pairs).alias("auc"))


def mean_over_folds(per_fold: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Macro mean of fold metrics; confusion counts are pooled."""
    pooled = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn") if c in per_fold.columns]
    return per_fold.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], *pooled)


def ragged_mean(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Element-wise mean of sequences; positions a sequence lacks are ignored."""
    cells = df.select(*keys, F.posexplode(sequence).alias("pos", "value"))
    means = cells.groupBy(*keys, "pos").agg(F.avg("value").alias("mean"))
    # The longest sequence bounds the collected array.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda e: e["mean"])
    return means.groupBy(*keys).agg(ordered.alias("mean_sequence"))


def best_rows(results: DataFrame, keys: list[str], metric: str, tie: list[str], n: int = 1, rank: str | None = None) -> DataFrame:
    """Best ``n`` rows per key by a metric, missing metrics last."""
    order = [F.col(metric).desc_nulls_last(), *[F.col(c) for c in tie]]
    if not keys:
        return results.orderBy(*order).limit(n)
    return keep_first(results, keys, order, n, rank)


def pivot_metric(results: DataFrame, rows: str, columns: str, values: list, metric: str) -> DataFrame:
    """Mean metric as a matrix; ``values`` lists the column keys."""
    return results.groupBy(rows).pivot(columns, values).agg(F.avg(metric).cast("double"))
