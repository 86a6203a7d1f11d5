"""Quality classifier by importance resampling.

Two bag-of-n-grams models over hashed unigrams and bigrams are counted, one from target texts (labelled good)
and one from all texts. A document's log weight is the sum over its n-grams of the log ratio of the models.
With Gumbel noise added, the k largest scores are a sample without replacement in proportion to the weights.

The model is ``BUCKETS`` pairs of counts, whatever the corpus: the only thing the driver sees. Target ids are
the ``MAX_TARGET`` labelled rows that come first by hash (a documented bound; below it, all), small enough to
broadcast, so texts are never shuffled. The k-th score is found by narrowing a bracket about it with exact counts;
at most ``EDGE`` rows are ever put in order, and rows of one score are told apart by id in the same way.

Edge cases: a null or empty text has no n-grams and log weight 0; noise depends on the seed and the id, so
reruns agree, repeated rows tie and ties go by id; rows with a null id are scored too and share one noise;
without target rows every weight is 0; an empty table gives an empty result. Only id and text are read, so
other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, query, stored, table, unit, word_hashes

BUCKETS = 10_000
MAX_TARGET = 100_000
ACCURACY = 10_000
EDGE = 20_000
SEED = "resample-1"


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the hashed unigrams and bigrams of several texts (ASCII letters lowered), and their texts."""
    words, doc = word_hashes([(t or "").encode().lower() for t in texts])
    pairs = np.flatnonzero(doc[1:] == doc[:-1])
    both = mixed(words[pairs] * np.uint64(0x9E3779B97F4A7C15) + words[pairs + 1])
    return (np.concatenate((words, both)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((doc, doc[pairs]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        grams, doc = ngrams(batch.column("text").to_pylist())
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        counts[0] += np.bincount(grams, minlength=BUCKETS)
        counts[1] += np.bincount(grams[good[doc]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(counts[0]), pa.array(counts[1])],
                                     ["bucket", "n", "n_good"])


def fit(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id",
        max_target: int = MAX_TARGET) -> list[float]:
    """Log ratio of the target model to the raw model for each bucket. ``target``: ``(doc_id)``."""
    ids = target.select(F.col("doc_id").alias("_good")).where("_good IS NOT NULL").distinct().orderBy(
        F.xxhash64("_good"), "_good").limit(max_target)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(
        F.broadcast(ids), F.col("_id") == F.col("_good"), "left")
    counted = rows.select("text", F.col("_good").isNotNull().alias("good")).mapInArrow(_count, "bucket int, n long, n_good long")
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.groupBy("bucket").agg(F.sum("n"), F.sum("n_good")).collect():
        raw[r[0]], good[r[0]] = r[1], r[2]
    if not good.sum():
        return [0.0] * BUCKETS
    return (np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))).tolist()


def weigh(docs: DataFrame, model: list[float], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_grams, log_weight)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.array(model)
        for batch in batches:
            grams, doc = ngrams(batch.column(1).to_pylist())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, ratio[grams], minlength=n))],
                ["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_grams long, log_weight double")


def first_rows(rows: DataFrame, k: int, order: list[str], most: int = EDGE) -> Column:
    """A condition that holds for the first ``k`` rows in the ascending order of some numeric columns.

    A bracket about the k-th value of the first column is narrowed by pivots from a sketch and exact counts of what
    lies below, at, between and above them, until at most ``most`` rows or one value are left; rows of one value are
    told apart by the next column. So no task orders more than ``most`` rows, however many share a value. ``rows``
    must be written rows, with no two equal in all columns."""
    kept, open_ = F.lit(False), F.lit(True)
    for name in order:
        c = F.col(name)
        while True:
            left = rows.where(open_)
            n = left.count()
            if k <= 0:
                return kept
            if k >= n:
                return kept | open_
            if n <= most:
                last = left.select(*order).orderBy(*order).limit(k).tail(1)[0]  # at most ``most`` rows
                upto = F.struct(*[F.col(x) for x in order]) <= F.struct(*[F.lit(last[x]).cast(rows.schema[x].dataType) for x in order])
                return kept | (open_ & upto)
            at = [min(1.0, max(0.0, k / n + side * 2 / ACCURACY)) for side in (-1, 1)]
            low, high = left.agg(F.percentile_approx(name, at, ACCURACY)).first()[0]
            zones = [c < F.lit(low), c == F.lit(low), c > F.lit(low)]
            if high > low:
                zones[2:] = [(c > F.lit(low)) & (c < F.lit(high)), c == F.lit(high), c > F.lit(high)]
            for i, size in enumerate(left.agg(*[F.count_if(z) for z in zones]).first()):
                if k <= size:
                    break
                kept, k = kept | (open_ & zones[i]), k - size
            open_ = open_ & zones[i]
            if i in (1, 3):
                break
    return kept | open_  # one row, the k-th


def gumbel_top_k(weighed: DataFrame, share: float, seed: str = SEED) -> DataFrame:
    """``weighed`` with ``score`` and ``kept``: true for the ``round(share * rows)`` largest scores; of equal scores
    the smaller ids, null first, and of rows that share an id any."""
    noise = -F.log(-F.log(unit(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    scored = weighed.withColumn("score", F.col("log_weight") + noise)
    rows = stored(scored.withColumns({"_down": -F.col("score"), "_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "_any": F.monotonically_increasing_id()}), "scores")
    kept = first_rows(rows, round(share * rows.count()), ["_down", "_id", "_any"])
    return rows.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("_down", "_id", "_any")


@query("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels.where("quality = 1"))
    # As many are kept as are good by the labels.
    share = labels.where("quality IS NOT NULL").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return gumbel_top_k(weigh(docs, model), 1.0 if share is None else share)
