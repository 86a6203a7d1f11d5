"""Exact top-k search by inner product over a vector-approximation file.

Equal vectors form one class: of a class only the ``k + 1`` smallest ids can be in any result, so copies cost
nothing. Every class gets an approximation, the number of its cell in each dimension (an even grid between the
smallest and largest component), and the approximations are written in blocks beside the exact vectors. A scan
reads approximations only: a cell's centre gives the score, the cell's half width an error, and so a lower and
an upper bound. Per query, classes whose upper bound is below the k-th largest lower bound are out. The exact
vectors of the rest are read in order of their upper bound: first those of the ``FIRST`` best, whose k-th score
then shows which others could still enter, and those alone are read too.

Query blocks meet vector blocks by an equi-join on (dimension, query block, group of vector blocks), so each
task holds one block of either, whatever the size of the table.

Edge cases: a null vector, one with null or non-finite components, or a null id takes no part; vectors of
different lengths are not compared; a repeated (id, vector) counts once, and no row with the query's id is in
its result; ties go to the smaller id; a query has fewer results if there are fewer candidates; an empty table
gives an empty result. Only id and vector are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import query, stored, table

K = 5
CELLS = 64
BLOCK = 4096
QUERIES = 1024
LATEST = 64
FIRST = 4


def scaled(vector: str, factor: float = 256.0) -> Column:
    """``floor(factor * x)`` of each component, null unless all are finite."""
    big = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def _blocks(grid: dict[int, tuple[list[int], list[int]]] | None, size: int):
    """Rows ``(cid, v)`` as blocks ``(dim, block, n, cids, data)``: cell numbers with a grid, else the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def emit(dim: int) -> pa.RecordBatch:
            nonlocal number
            cids, rows = held.pop(dim)
            m = np.array(rows, np.int64).reshape(len(rows), dim)
            if grid is None:
                data = m.astype("<i8").tobytes()
            else:
                low, high = (np.array(x, np.float64) for x in grid[dim])
                step = np.maximum((high - low) / CELLS, 1e-9)
                data = np.minimum((m - low) // step, CELLS - 1).astype(np.uint8).tobytes()
            number += 1
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "block": pa.array([number - 1], pa.int64()), "n": pa.array([len(rows)], pa.int32()),
                "cids": pa.array([np.array(cids, "<i8").tobytes()]), "data": pa.array([data])})

        for batch in batches:
            for cid, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cids, rows = held.setdefault(len(v), ([], []))
                cids.append(cid)
                rows.append(v)
                if len(rows) >= size:
                    yield emit(len(v))
        for dim in list(held):
            yield emit(dim)

    return run


def _scan(grid: dict[int, tuple[list[int], list[int]]], k: int):
    """Bounds of a query block against a vector block; what can't be among the k best of the blocks that the
    task has seen for these queries is out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}  # of the latest query blocks, each query's k largest lower bounds
        for batch in batches:
            out = []
            for dim, block, qn, qc, qd, vn, vc, vd in zip(*[c.to_pylist() for c in batch.columns]):
                low, high = (np.array(x, np.float64) for x in grid[dim])
                step = np.maximum((high - low) / CELLS, 1e-9)
                q = np.frombuffer(qd, "<i8").reshape(qn, dim).astype(np.float64)
                centre = low + (np.frombuffer(vd, np.uint8).reshape(vn, dim) + 0.5) * step
                score = q @ centre.T
                # Half a cell in every dimension, and room for rounding.
                error = np.abs(q) @ (step / 2) * (1 + 1e-9) + 1e-6 * (1 + np.abs(score).max(axis=1, initial=0))
                lower = (np.partition(score, vn - k, axis=1)[:, vn - k:] if vn > k else score) - error[:, None]
                known = np.concatenate((seen.pop(block, np.full((qn, k), -np.inf)), lower), axis=1)
                seen[block] = known = np.partition(known, known.shape[1] - k, axis=1)[:, -k:]
                if len(seen) > LATEST:
                    seen.pop(next(iter(seen)))
                i, j = np.nonzero(score + error[:, None] >= known.min(axis=1)[:, None])
                out.append((np.frombuffer(qc, "<i8")[i], np.frombuffer(vc, "<i8")[j], score[i, j] - error[i], score[i, j] + error[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[c] for o in out]) if out else [], t) for c, t in enumerate(
                    (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["q", "cid", "low", "high"])

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
          factor: float = 256.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row with ``is_query``, the k other rows of highest score."""
    valid = rows.where(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), scaled(vector, factor).alias("v"), is_query.alias("is_query")).where("v IS NOT NULL")
    valid = stored(valid, "vectors")
    few = valid.select("id", "v").distinct().withColumn(
        "_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    classes = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn(
        "cid", F.monotonically_increasing_id()), "classes")
    asked = stored(valid.where("is_query").select("id", "v").distinct().join(classes.select("v", "cid"), "v").select(
        F.col("id").alias("query_id"), F.col("cid").alias("q")), "asked")
    vectors = classes.select("cid", "v")
    ends = classes.select(F.size("v").alias("dim"), F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(
        F.min("x").alias("low"), F.max("x").alias("high")).orderBy("dim", "pos").collect()  # one row per dimension
    grid: dict[int, tuple[list[int], list[int]]] = {0: ([], [])}
    for e in ends:
        low, high = grid.setdefault(e["dim"], ([], []))
        low.append(e["low"])
        high.append(e["high"] + 1)
    schema = "dim int, block long, n int, cids binary, data binary"
    approximations = stored(vectors.mapInArrow(_blocks(grid, BLOCK), schema), "cells")
    wanted = vectors.join(asked.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi")
    questions = stored(wanted.mapInArrow(_blocks(None, QUERIES), schema), "questions")

    # Every query block with every vector block of its dimension, dealt by (query block, group of blocks).
    groups = max(1, approximations.count() // 8)
    blocks = questions.select("dim", F.col("block").alias("qblock")).groupBy("dim").agg(F.collect_list("qblock").alias("qblocks"))
    left = questions.select("dim", F.col("block").alias("qblock"), F.col("n").alias("qn"), F.col("cids").alias("qc"),
                            F.col("data").alias("qd"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = approximations.join(blocks, "dim").select(
        "dim", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), "n", "cids", "data", F.explode("qblocks").alias("qblock"))
    pairs = left.join(right, ["dim", "qblock", "g"]).select("dim", "qblock", "qn", "qc", "qd", "n", "cids", "data")
    bounded = stored(pairs.mapInArrow(_scan(grid, k + 1), "q long, cid long, low double, high double"), "bounds")
    by_low = Window.partitionBy("q").orderBy(F.desc("low"))
    kth = bounded.withColumn("_r", F.row_number().over(by_low)).where(F.col("_r") <= k + 1).groupBy("q").agg(
        F.min("low").alias("least"), F.count("*").alias("n"))
    open_ = bounded.join(kth, "q").where((F.col("n") <= k) | (F.col("high") >= F.col("least")))
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("high"), "cid"))
    open_ = stored(open_.select("q", "cid", "high").withColumn("place", order), "open")

    def exact(some: DataFrame) -> DataFrame:
        return some.join(vectors, "cid").join(vectors.select(F.col("cid").alias("q"), F.col("v").alias("w")), "q").select(
            "q", "cid", _dot(F.col("v"), F.col("w")).alias("score"))

    first = stored(exact(open_.where(F.col("place") <= FIRST * k)), "first")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"))
    certain = first.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") == k + 1).select("q", F.col("score").alias("kth"))
    rest = open_.where(F.col("place") > FIRST * k).join(certain, "q").where(F.col("high") >= F.col("kth"))
    scores = first.unionByName(exact(rest)).join(classes.select("cid", "ids"), "cid")
    # Of a class, ids in order; of all, by score and id.
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    top = scores.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    whole = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = stored(top.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k + 1).drop("_r"), "top")
    own = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return asked.join(top, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""


@query("op4_top_k", ORACLE)
def op4_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
