"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents with equal texts form a group that is placed as one, unless it is by itself larger than a whole shard
in some measure; then it is split into pieces of about ``1 / PIECES`` of a shard. Every group goes to the shard where
the dot product of its (bytes, tokens, rows) with the shard's residual capacity is highest, largest first; a measure
that a shard has used up counts as none left, so that what it still has of the others is filled.

Groups above ``1 / LARGE`` of a shard are at most ``3 * shards * LARGE`` by their size, so the driver places
those. The rest are dealt by hash into parts of about ``PART`` groups; each part gets its share of every
shard's residual capacity and places its groups by the same rule, in parallel.

Edge cases: a null text counts as empty; null ids are allowed; repeated rows are members of one group; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, query, stored, table

SHARDS = 24
PIECES = 16
LARGE = 64
PART = 20_000
SLOTS = 5_000
MEASURES = ("_bytes", "_tokens", "_rows")


def place(units: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each unit (one row of measures each), largest first; ``residual`` is used up in place.

    Measures are taken relative to all capacity, so that they weigh alike in the dot product."""
    scale = np.maximum(np.abs(residual).sum(axis=0), 1e-9)
    units, left = units / scale, residual / scale
    out = np.empty(len(units), np.int32)
    for i in np.argsort(-units.max(axis=1), kind="stable"):
        open_ = np.maximum(left, 0) @ units[i]
        best = int(np.argmax(open_)) if open_.any() else int(np.argmax(left @ units[i]))
        out[i] = best
        left[best] -= units[i]
    residual[:] = left * scale
    return out


def _parts(capacity: list[list[float]], totals: list[float]):
    whole = np.array(totals)

    def of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_gid", "_sub"], ignore_index=True)
        units = group[list(MEASURES)].to_numpy(float)
        share = units.sum(axis=0) / np.maximum(whole, 1e-9)
        return group[["_gid", "_sub"]].assign(shard=place(units, np.array(capacity) * share))

    return of


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (with ``_gid``, ``_salt`` in [0, 1), ``_bytes`` and ``_tokens``) and the ``shard`` of each."""
    sums = [F.sum("_bytes").alias("_bytes"), F.sum("_tokens").alias("_tokens"), F.count("*").alias("_rows")]
    groups = stored(rows.groupBy("_gid").agg(*sums), "shard-groups")
    total = [float(x or 0) for x in groups.agg(*[F.sum(m) for m in MEASURES], F.count("*")).first()]
    of_shard = [max(t / shards, 1e-9) for t in total[:3]]
    share = F.greatest(*[F.col(m) / F.lit(s) for m, s in zip(MEASURES, of_shard)])
    pieces = F.ceil(share * PIECES)
    # Fewer than 3 * shards groups can be that large: a bounded broadcast.
    split = groups.where((share > 1) & (F.col("_rows") > 1)).select("_gid", F.least(pieces, F.col("_rows")).alias("_pieces"))
    rows = rows.join(F.broadcast(split), "_gid", "left").withColumn(
        "_sub", F.coalesce(F.floor(F.col("_salt") * F.col("_pieces")), F.lit(0)))
    units = stored(rows.groupBy("_gid", "_sub").agg(*sums), "shard-units")
    large = share * LARGE > 1
    big = units.where(large).orderBy("_gid", "_sub").toPandas()
    residual = np.tile(of_shard, (shards, 1))
    big = big.assign(shard=place(big[list(MEASURES)].to_numpy(float), residual))
    rest = units.where(~large)
    n, *left = rest.agg(F.count("*"), *[F.sum(m) for m in MEASURES]).first()
    parts = max(1, round(n / PART))
    small = (rest.withColumn("_part", F.pmod(F.xxhash64("_gid", "_sub"), F.lit(parts)))
             .groupBy("_part").applyInPandas(
                 _parts(residual.tolist(), [float(x or 0) for x in left]), "_gid string, _sub long, shard int"))
    placed = small
    if len(big):
        placed = small.unionByName(rows.sparkSession.createDataFrame(
            big[["_gid", "_sub", "shard"]], "_gid string, _sub long, shard int"))
    return rows.join(placed, ["_gid", "_sub"]).drop("_pieces")


def with_slots(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot``: gapless from 0 in each shard. Shards are cut by salt into chunks of about
    ``slots`` rows; chunk counts are summed in order, and rows are numbered within their chunk only."""
    chunks = max(1, round(rows.count() / SHARDS / slots))
    rows = rows.withColumn("_chunk", F.floor(F.col("_salt") * chunks))
    ahead = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_chunk").agg(F.count("*").alias("_n")).select(
        "shard", "_chunk", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("shard", "_chunk").orderBy("_salt", "_gid")
    return rows.join(offsets, ["shard", "_chunk"]).withColumn(
        "slot", F.col("_ahead") + F.row_number().over(within) - 1)


def shard(docs: DataFrame, text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` without the text, with ``size`` (UTF-8 bytes + 8), ``text_crc32``, ``law``, ``shard``, ``slot``
    and ``grown_shard`` (null: the law is ``bytes``, a change of the number of shards deals anew)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = [c for c in docs.columns if c not in (text, *made)]
    rows = stored(docs.select(
        *keep, (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.md5(whole).alias("_gid"), F.rand(7).alias("_salt"), (F.octet_length(whole) + 8).cast("long").alias("_bytes"),
        n_words(whole).alias("_tokens")), "shard-rows")
    placed = with_slots(stored(assign(rows, shards), "shard-placed"))
    return placed.select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op7_shard")
def op7_shard(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
